"""Items, authors, memberships and attachments of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

HIDDEN_TYPES = ("attachment", "note")
HEAVY_TYPES = ("book", "bookSection", "thesis")
FIELDS = ("title", "date", "DOI")
STORAGE_PREFIX = "storage:"


def not_in(rows: DataFrame, trash: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in the trash table."""
    return rows.join(trash.select(key).distinct(), key, "left_anti")


def library_items(items: DataFrame, types: DataFrame, data: DataFrame, values: DataFrame, fields: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row for each live item that is neither attachment nor note, its fields side by side.

    Items without any field stay, with nulls. Of several values of a field the greatest counts.
    """
    live = not_in(items, deleted, "itemID").join(types, "itemTypeID").filter(~F.col("typeName").isin(*HIDDEN_TYPES))
    named = data.join(values, "valueID").join(fields.filter(F.col("fieldName").isin(*FIELDS)), "fieldID")
    wide = named.groupBy("itemID").agg(*(F.max(F.when(F.col("fieldName") == f, F.col("value"))).alias(f.lower()) for f in FIELDS))
    return live.join(wide, "itemID", "left").select(
        "itemID",
        F.col("key").alias("item_key"),
        F.col("typeName").alias("item_type"),
        "title",
        "date",
        X.first_year(F.col("date")).alias("year"),
        X.normalize_doi(F.col("doi")).alias("doi"),
        F.col("typeName").isin(*HEAVY_TYPES).alias("is_book_default_off"),
    )


def papers(items: DataFrame) -> DataFrame:
    """doc_id and title of items; a blank title gives way to the key."""
    return items.select(F.col("item_key").alias("doc_id"), X.first_present(F.col("title"), F.col("item_key")).alias("title"))


def listing_order() -> list:
    """Items by year (as text, none first) and lower-cased title; ties by key."""
    return [F.coalesce("year", F.lit("")), F.lower(F.coalesce("title", F.lit(""))), F.col("item_key")]


def listing(items: DataFrame) -> DataFrame:
    return items.orderBy(*listing_order())


def source_state(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """One row: whether there is a library at all (a snapshot or the live one), and whether the live one is there."""
    some = lambda df, name: df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
    both = some(snapshot, "snapshot").crossJoin(F.broadcast(some(live, "live")))
    return both.select((F.col("snapshot") | F.col("live")).alias("present"), "live")


def authors(item_creators: DataFrame, creators: DataFrame) -> DataFrame:
    """itemID and its authors' names in order, blank names left out."""
    name = X.author_name(F.col("lastName"), F.col("firstName"), F.col("fieldMode"))
    rows = item_creators.join(creators, "creatorID").select("itemID", "orderIndex", name.alias("name"))
    ordered = F.sort_array(F.collect_list(F.struct("orderIndex", "name")))
    return rows.filter("name <> ''").groupBy("itemID").agg(F.transform(ordered, lambda x: x["name"]).alias("authors"))


def memberships(collection_items: DataFrame, items: DataFrame, deleted_items: DataFrame, deleted_collections: DataFrame) -> DataFrame:
    """Distinct (collectionID, item_key) of live items in live collections."""
    live = not_in(not_in(collection_items, deleted_items, "itemID"), deleted_collections, "collectionID")
    return live.join(items.select("itemID", F.col("key").alias("item_key")), "itemID").select("collectionID", "item_key").distinct()


def primary_attachments(attachments: DataFrame, items: DataFrame, files: DataFrame, storage_dir: str) -> DataFrame:
    """parentItemID and path of the first stored PDF (by attachment id) whose file exists."""
    stored = attachments.filter((F.col("contentType") == "application/pdf") & (F.col("linkMode") == 0) & F.col("path").ilike(f"{STORAGE_PREFIX}%"))
    name = F.substring("path", F.lit(len(STORAGE_PREFIX) + 1), F.length("path"))
    full = F.concat(F.lit(storage_dir.rstrip("/") + "/"), F.col("key"), F.lit("/"), name)
    named = stored.join(items.select("itemID", "key"), "itemID").select("itemID", "parentItemID", full.alias("file"))
    found = named.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    return found.groupBy("parentItemID").agg(F.min_by("file", "itemID").alias("path"))


def indexable_keys(items: DataFrame, attached: DataFrame, within: DataFrame) -> DataFrame:
    """Keys of the items in within(item_key) that have a PDF and aren't off by default."""
    usable = items.filter(~F.col("is_book_default_off")).join(attached.select(F.col("parentItemID").alias("itemID")), "itemID", "left_semi")
    return usable.join(within.select("item_key").distinct(), "item_key", "left_semi").select("item_key")
