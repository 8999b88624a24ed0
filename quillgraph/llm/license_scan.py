"""Operator 9, license scans: a positional index of rare words. DataFrame functions only.

Every row's words that occur in licence templates are noted; their document frequencies over the
whole table give inverse document frequencies. The ANCHORS words of a template that are the rarest
there, with their positions, are its postings. Of a text that holds all mandatory key phrases of a
template, the postings are intersected by relative position: those at the same place (word in the
text minus word in the template) vote together. The template is found where enough of its anchors'
weight agrees on one place.

Texts are brought to a form in which each word has a space of its own before and behind
(" mit  license "), so that phrases are counted and located with plain string functions; only texts
with a template's key phrases are split into words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, saved, table
from .licenses import TEMPLATES

#: Fixed by contract: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words of a template, the rarest of the table, that are its anchors.
ANCHORS = 8
#: Share of a template's anchor weight that must agree on one place.
AGREE = 0.6

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.sub(SEPARATORS, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def anchors(templates, frequencies: dict[str, int], n: int) -> list[tuple[int, str, str, int, float]]:
    """(template, label, word, position, share of the template's weight) of all anchors, from the document frequencies in n rows."""
    out = []
    for number, (label, text, _) in enumerate(templates):
        words = words_of(text)
        weight = {w: round(math.log(1 + (n + 1) / (frequencies.get(w, 0) + 1)), 6) for w in words}
        rare = set(sorted(weight, key=lambda w: (-weight[w], w))[:ANCHORS])
        places = [(w, p) for p, w in enumerate(words) if w in rare]
        total = sum(weight[w] for w, _ in places)
        out += [(number, label, w, p, weight[w] / total) for w, p in places]
    return out


def gates(groups: list[list[str]]) -> list[str] | None:
    """Few words of which each group of words has one, so that a text with none of them holds no group; None if a group is empty.

    They are sought among each group's longest words, for long words are seldom in other texts.
    """
    left, out = [set(sorted(set(g), key=lambda w: (-len(w), w))[:4]) for g in groups], []
    if not all(left):
        return None
    while left:
        counts: dict[str, int] = {}
        for group in left:
            for w in group:
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        out.append(best)
        left = [g for g in left if best not in g]
    return out


def _any_of(s: Column, words: list[str] | None) -> Column:
    found = F.lit(words is None)
    for word in words or []:
        found = found | s.contains(word)
    return found


def _spaced(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _n_words(spaced: Column) -> Column:
    """Words of a text in the spaced form, or of its head or tail."""
    gaps = (F.length(spaced) - F.length(F.replace(spaced, F.lit("  "), F.lit("")))) / 2
    return F.when(F.length(spaced) > 1, gaps.cast("bigint") + 1).otherwise(F.lit(0).cast("bigint"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased. n_base counts the places
    of the base phrases; first_word and last_word are the least and greatest start among them (words
    from 0), null without any. labels: the base labels and those of the templates found, distinct,
    sorted, comma-joined (empty without any). score: the largest share of anchor weight that a found
    template got, 1 where a base phrase stands. A null text is empty; texts of any length are scanned
    whole. Words of equal frequency are ranked by code point. Every one of repeated rows is scanned by
    itself (and counts in the frequencies). An empty table gives no rows; other columns don't matter.
    templates: (label, text, key phrases in words of the text); a small table, for it is broadcast.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text, _ in templates for w in words_of(text)})
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("id"), F.trim(F.regexp_replace(lower, SEPARATORS, "  ")).alias("s"))
    rows = rows.select("id", F.when(F.length("s") > 0, F.concat(F.lit(" "), "s", F.lit(" "))).otherwise(F.lit("")).alias("s"))
    s = F.col("s")
    n_words = _n_words(s)
    # only texts with a word that each phrase, or each template, needs are looked at closely
    worth = _any_of(s, gates([p.split() for p in base]))
    count, first, last, labels = F.lit(0), [], [], []
    for phrase, label in base.items():
        spaced = _spaced(phrase)
        n = F.when(worth, ((F.length(s) - F.length(F.replace(s, F.lit(spaced), F.lit("")))) / len(spaced)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        count = count + n
        first.append(F.when(n > 0, _n_words(F.substring(s, F.lit(1), F.instr(s, spaced) - 1))))
        last.append(F.when(n > 0, n_words - _n_words(F.substring_index(s, spaced, -1)) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    gate = _any_of(s, gates([[w for p in phrases for w in p.split()] for _, _, phrases in templates]))
    among = lambda columns, of: of(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(None).cast("bigint")
    scanned = saved(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            n_words.alias("n_words"),
            count.cast("bigint").alias("n_base"),
            among(first, F.least).alias("first_word"),
            among(last, F.greatest).alias("last_word"),
            F.array_sort(F.array_compact(F.array(*labels, F.lit(None).cast("string")))).alias("base"),
            F.array_intersect(F.split(F.trim("s"), "  "), F.array(*(F.lit(w) for w in vocabulary))).alias("known"),
            F.when(gate, s).alias("s"),
        )
    )
    # as many rows as the templates have words
    frequencies = {r["word"]: r["n"] for r in scanned.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = anchors(templates, frequencies, scanned.count())
    keys = {n: _all_in(phrases) for n, (_, _, phrases) in enumerate(templates)}
    gated = scanned.filter(s.isNotNull())
    for n, holds in keys.items():
        gated = gated.withColumn(f"k{n}", holds)
    any_key = F.lit(False)
    for n in keys:
        any_key = any_key | F.col(f"k{n}")
    gated = gated.filter(any_key).withColumn("verified", F.array_compact(F.array(*(F.when(F.col(f"k{n}"), F.lit(n)) for n in keys)))).select("row", "verified", "s")
    # the index is as large as the templates
    postings = F.broadcast(spark.createDataFrame(index, "template int, label string, word string, at int, share double"))
    words = gated.select("row", "verified", F.posexplode(F.split(F.trim("s"), "  ")).alias("pos", "word"))
    looked_up = words.join(postings, "word").filter(F.array_contains("verified", F.col("template")))
    votes = looked_up.groupBy("row", "template", "label", (F.col("pos") - F.col("at")).alias("place")).agg(F.round(F.sum("share"), 6).alias("share"))
    found = votes.filter(F.col("share") >= AGREE).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("best"))
    out = scanned.join(found, "row", "left")
    return out.select(
        F.col("id").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.round(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)), 6)).alias("score"),
    )


def _all_in(phrases: list[str]) -> Column:
    out = F.lit(True)
    for phrase in phrases:
        out = out & F.col("s").contains(_spaced(phrase))
    return out


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = ", ".join(f"({n}, '{label}', '{w}', {at})" for n, (label, text, _) in enumerate(TEMPLATES) for at, w in enumerate(words_of(text)))
    keys = ", ".join(f"({n}, '{_spaced(p)}')" for n, (_, _, phrases) in enumerate(TEMPLATES) for p in phrases)
    base = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())
    return rf"""
WITH t(template, label, word, anchor) AS (VALUES {words}),
keys(template, phrase) AS (VALUES {keys}),
base(phrase, label, n) AS (VALUES {base}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS MATERIALIZED (
  SELECT row, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d
), q AS (
  SELECT row, pos, word || ' ' || lead(word) OVER o AS two, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three FROM p WINDOW o AS (PARTITION BY row ORDER BY pos)
), b AS (
  SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM q JOIN base ON CASE WHEN base.n = 2 THEN two ELSE three END = base.phrase GROUP BY row
), v AS (
  SELECT d.row, k.template FROM d, keys k
  GROUP BY d.row, k.template HAVING bool_and(contains(' ' || array_to_string(d.w, '  ') || ' ', k.phrase))
), idf AS (
  SELECT word, round(ln(1 + ((SELECT count(*) FROM d) + 1)::DOUBLE / (count(DISTINCT p.row) + 1)), 6) AS idf FROM (SELECT DISTINCT word FROM t) LEFT JOIN p USING (word) GROUP BY word
), rare AS (
  SELECT template, word, idf FROM (SELECT template, word, idf, row_number() OVER (PARTITION BY template ORDER BY idf DESC, word) AS k FROM (SELECT DISTINCT template, word FROM t) JOIN idf USING (word)) WHERE k <= {ANCHORS}
), idx AS (
  SELECT template, label, word, anchor, idf / sum(idf) OVER (PARTITION BY template) AS share FROM t JOIN rare USING (template, word)
), votes AS (
  SELECT row, template, label, pos - anchor AS place, round(sum(share), 6) AS share
  FROM p JOIN idx USING (word) JOIN v USING (row, template) GROUP BY ALL HAVING round(sum(share), 6) >= {AGREE}
), f AS (
  SELECT row, list(DISTINCT label) AS found, max(share) AS best FROM votes GROUP BY row
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.found, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE round(least(coalesce(f.best, 0.0), 1.0), 6)::DOUBLE END AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN f USING (row)
"""


SQL = _sql()
