"""Citation caches as VARIANT: what a record holds stays as it is, typed columns are views of it.

An entry of a list is an object or a bare id. Fields that this library doesn't know survive a round trip,
bare ids stay bare until a lookup knows them, and nothing is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(item_key, record) of a cache with one {"item_key": ..., ...} a line; lines that can't be parsed or have no key are left out."""
    key = lambda record: F.try_variant_get(record, "$.item_key", "string")
    # not a filter over a parsed column: pushed below it, it would parse each line a second time
    parsed = spark.read.text(path).select(F.explode(F.filter(F.array(F.try_parse_json("value")), lambda r: key(r).isNotNull())).alias("record"))
    return parsed.select(key("record").alias("item_key"), "record")


def write_lines(records: DataFrame, path: str) -> None:
    """Writes (item_key, record) in the same format."""
    records.select(F.to_json("record").alias("value")).write.text(path)


def _bare(entry: Column) -> Column:
    """Whether an entry is an id alone."""
    return F.schema_of_variant(entry) == "STRING"


def _list(record: Column, column: str) -> Column:
    """A record's list; one that is missing or no list is empty."""
    return F.coalesce(F.try_variant_get(record, f"$.{column}", "array<variant>"), F.array().cast("array<variant>"))


def entries(records: DataFrame, column: str = "references", more: str = "") -> DataFrame:
    """(item_key, further columns of records, ref_pos, id, bare, title, year, citedBy, fields of `more`, entry) of every entry; null ids stay.

    more: further fields as "name:type,...". Fields of another type are null.
    """
    e = F.col("entry")
    kept = [c for c in records.columns if c != "record"]
    rows = records.select(*kept, F.posexplode(_list(F.col("record"), column)).alias("ref_pos", "entry")).select("*", _bare(e).alias("bare"))
    # one look for all fields: a path that leads nowhere costs more than all of them
    seen = rows.select("*", F.when(~F.col("bare"), F.try_variant_get(e, "$", f"struct<id:string,title:string,year:int,citedBy:bigint{more and ','}{more}>")).alias("f"))
    named = F.when(F.col("bare"), F.try_variant_get(e, "$", "string")).otherwise(F.col("f.id"))
    return seen.select(*kept, "ref_pos", named.alias("id"), "bare", *(F.col(f"f.{c}") for c in seen.schema["f"].dataType.names[1:]), "entry")


def resolved(records: DataFrame, works: DataFrame, column: str = "references") -> DataFrame:
    """records in whose list bare ids that works(id, ...) knows have become objects of its columns; all else is as it was.

    Only bare ids travel to the works, and only found works to the records; objects never leave their record.
    """
    named = lambda e: F.when(_bare(e), F.try_variant_get(e, "$", "string"))
    asked = records.select("item_key", F.posexplode(F.transform(_list(F.col("record"), column), named)).alias("ref_pos", "__id")).filter("__id IS NOT NULL")
    known = works.select(F.col("id").alias("__id"), F.to_variant_object(F.struct(*works.columns)).alias("work"))
    # an item's found works are as many as its own bare ids
    found = asked.join(known, "__id").groupBy("item_key").agg(F.collect_list(F.struct("ref_pos", F.col("__id").alias("id"), "work")).alias("__found"))
    joined = records.join(found, "item_key", "left").withColumn("__list", F.when(F.col("__found").isNotNull(), _list(F.col("record"), column)))
    # places in order, each as itself and then as the works found for it: the last of a place counts
    own = F.transform("__list", lambda e, i: F.struct(i.alias("pos"), F.lit(-1).alias("n")))
    hit = F.transform("__found", lambda w, n: F.struct(w["ref_pos"].alias("pos"), F.when(named(F.get("__list", w["ref_pos"])) == w["id"], n).alias("n")))
    placed = joined.withColumn("__order", F.sort_array(F.concat(own, F.filter(hit, lambda o: o["n"].isNotNull()))))
    last = F.filter("__order", lambda o, k: ~F.coalesce(F.get("__order", k + 1)["pos"] == o["pos"], F.lit(False)))
    done = F.transform(last, lambda o: F.when(o["n"] < 0, F.get("__list", o["pos"])).otherwise(F.get("__found", o["n"])["work"]))
    whole = F.try_variant_get("record", "$", "map<string,variant>")
    changed = F.map_concat(F.map_filter(whole, lambda k, v: k != column), F.create_map(F.lit(column), F.to_variant_object(done)))
    return placed.select("item_key", F.when(F.col("__found").isNull(), F.col("record")).otherwise(F.to_variant_object(changed)).alias("record"))
