"""Text rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(c) for c in columns[:-1]), columns[-1])


def ws_trim(c: Column) -> Column:
    """Without white space of any kind at either end; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_doi(c: Column) -> Column:
    """Lower-case DOI without a resolver address; null when nothing is left."""
    bare = F.regexp_replace(ws_trim(c), r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
    return blank_to_null(F.lower(ws_trim(bare)))


def strip_doi_address(c: Column) -> Column:
    """The DOI in its own case without "https://doi.org/", "http://doi.org/" or "doi.org/"; empty is null."""
    return blank_to_null(F.regexp_replace(c, r"(?i)^(https?://)?doi\.org/", ""))


def short_id(c: Column) -> Column:
    """The last path segment of an identifier address; null gives the empty text."""
    return F.element_at(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"/+$", ""), "/"), -1)


def first_year(c: Column) -> Column:
    """The first four digits in a row, as text, or null."""
    return blank_to_null(F.regexp_extract(c, r"(\d{4})", 1))


def author_name(last: Column, first: Column, single_field: Column) -> Column:
    """"Last, First"; the last name alone for one-field names; whatever there is otherwise."""
    last, first = F.trim(F.coalesce(last, F.lit(""))), F.trim(F.coalesce(first, F.lit("")))
    return F.when((F.coalesce(single_field, F.lit(0)) == 1) | (first == ""), last).when(last != "", F.concat(last, F.lit(", "), first)).otherwise(first)


def title_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of letters a-z and digits."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " +")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def token_overlap(query: Column, title: Column) -> Column:
    """The share of the query's tokens that the title has; null if either has none."""
    q, t = title_tokens(query), title_tokens(title)
    return F.when((F.size(q) > 0) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q))


def slug(c: Column, length: int = 60) -> Column:
    """Lower-case letters and digits joined by single hyphens, cut to length, no hyphen at the ends."""
    joined = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, length)
    return F.regexp_replace(cut, "^-+|-+$", "")


def audio_name(title: Column, job_id: Column) -> Column:
    s = slug(title)
    return F.when(s != "", F.concat(s, F.lit("--"), job_id, F.lit(".mp3"))).otherwise(F.concat(job_id, F.lit(".mp3")))


def progress(base: int, span: int, i: Column, n: Column) -> Column:
    return F.lit(base) + (F.lit(span) * i / n).cast("int")


def utf16_units(c: Column) -> Column:
    """The UTF-16 code units of a text; characters beyond the BMP give two."""
    units = F.transform(
        F.split(c, ""),
        lambda ch: F.when(F.ascii(ch) > 0xFFFF, F.array(0xD800 + F.shiftright(F.ascii(ch) - 0x10000, 10), 0xDC00 + (F.ascii(ch) - 0x10000).bitwiseAND(0x3FF))).otherwise(F.array(F.ascii(ch))),
    )
    return F.when(c == "", F.array().cast("array<int>")).otherwise(F.flatten(units))


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 units."""
    return F.aggregate(utf16_units(c), F.lit(2166136261).cast("bigint"), lambda h, x: (h.bitwiseXOR(x.cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv_unit(c: Column) -> Column:
    """The hash as a number from 0 to 1."""
    return fnv1a(c) / F.lit(4294967295.0)


def palette_index(c: Column, colours: int = 15) -> Column:
    """Index of a name's colour; null for a missing name (the default colour)."""
    h = F.aggregate(utf16_units(c), F.lit(0).cast("bigint"), lambda h, x: (h * 31 + x.cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(blank_to_null(c).isNotNull(), (h % colours).cast("int"))


def author_line(authors: Column, shown: int = 3) -> Column:
    """The first authors, "et al." if there are more."""
    names = F.array_join(F.slice(authors, 1, shown), ", ")
    return F.when(F.size(authors) > shown, F.concat(names, F.lit(" et al."))).otherwise(names)


def detail_line(year: Column, cited_by: Column, external: Column) -> Column:
    return F.concat_ws(" · ", year.cast("string"), F.when(cited_by.isNotNull(), F.concat(cited_by.cast("string"), F.lit(" citations"))), F.when(external, F.lit("external")))


def passage_form(c: Column) -> Column:
    """Lower-case, runs of white space as one space, without dots at the very end, then trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"[.]+\z", ""))


def passage_needle(c: Column, words: int = 8) -> Column:
    """The first words of a passage."""
    return F.array_join(F.slice(F.split(passage_form(c), " "), 1, words), " ")


#: Characters that a block must have to count as part of a passage.
LEAST_BLOCK = 4


def passage_hit(block: Column, passage: Column) -> Column:
    """Whether a block shows a passage: it stands in the passage as a whole, or the passage's first words stand in it. Short blocks never do."""
    form, needle = passage_form(block), passage_needle(passage)
    return (F.length(form) >= LEAST_BLOCK) & (F.contains(passage_form(passage), form) | ((needle != "") & F.contains(form, needle)))


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: What is taken out or replaced before text is spoken, in this order.
SPEECH_STEPS = (
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"https?://\S+", ""),
    (r"```", " "),
    (r"`", ""),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"(?m)^\s{0,3}>\s?", ""),
    (r"(?m)^\s{0,3}([-*+]|\d{1,2}[.)])\s+", ""),
    (r"\*+", ""),
    (r"~~", ""),
    (r"__([^_]+)__", "$1"),
    (r"(?U)(?<!\w)_([^_]+)_(?!\w)", "$1"),
    (r"\|", " "),
    ("•", ", "),
    ("–", "-"),
    ("—", ", "),
    ("[“”]", '"'),
    ("[‘’]", "'"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
)


def clean_for_speech(c: Column) -> Column:
    for pattern, by in SPEECH_STEPS:
        c = F.regexp_replace(c, pattern, by)
    return ws_trim(c)


def speech_chunks(c: Column, most: int = 400) -> Column:
    """Sentences packed greedily into chunks of at most `most` characters.

    A longer sentence is packed by its clauses; a longer clause stays whole, so that a chunk can
    exceed the limit.
    """
    flat = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    flat = F.replace(ws_trim(flat), F.lit("\n"), F.lit(" "))
    sentences = F.transform(F.split(flat, r"(?U)(?<=[.!?])\s+"), ws_trim)
    units = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > most, F.transform(F.split(s, r"(?U)(?<=[,;:])\s+"), ws_trim)).otherwise(F.array(s))))
    units = F.filter(units, lambda u: u != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, unit: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(unit) + 1 <= most
        whole = F.concat(acc["done"], F.array(acc["cur"]))
        return F.when(fits, F.struct(acc["done"].alias("done"), F.trim(F.concat(acc["cur"], F.lit(" "), unit)).alias("cur"))).otherwise(
            F.struct(F.when(acc["cur"] != "", whole).otherwise(acc["done"]).alias("done"), unit.alias("cur"))
        )

    return F.aggregate(units, start, add, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


#: Fixed value: a line that is nothing but the heading of a bibliography.
BIBLIOGRAPHY = r"^\s*(?:\d{1,2}\.?\s+)?(?:references|bibliography|works\s+cited|literature\s+cited|reference\s+list)\s*:?\s*$"


def strip_bibliography(c: Column) -> Column:
    """The text before the last bibliography heading, else all of it; trimmed."""
    found = c.rlike(f"(?im){BIBLIOGRAPHY}")
    return ws_trim(F.when(found, F.regexp_extract(c, rf"(?ims)\A(.*){BIBLIOGRAPHY}", 1)).otherwise(c))
