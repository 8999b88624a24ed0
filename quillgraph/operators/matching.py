"""Finding papers by typed titles: containment by positional q-grams, overlap by rare tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import written

ACCEPT = 0.45
#: Characters of a gram. Shorter strings are looked up whole.
GRAM = 3


def _grams(text: Column, size: int = GRAM) -> Column:
    """The substrings of so many characters, in order; none of shorter texts."""
    last = F.length(text) - (size - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _rarest(inner: DataFrame, outer: DataFrame, by: list[str]) -> DataFrame:
    """(by, s, gram, at) of inner(by, s): of each string the gram that fewest strings of outer(by, s) have, and its first place.

    Strings with a gram that none of outer has can't stand in any of them and are left out.
    """
    key = [*by, "gram"]
    own = inner.select(*by, "s", F.posexplode(_grams(F.col("s"))).alias("at", "gram"))
    # only grams that are asked for are counted
    asked = own.select(*key).distinct()
    known = outer.select(*by, F.explode(F.array_distinct(_grams(F.col("s")))).alias("gram")).join(asked, key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("strings"))
    ranked = own.join(known, key, "left").groupBy(*by, "s").agg(F.min(F.struct(F.coalesce("strings", F.lit(0)).alias("strings"), "at", "gram")).alias("g"))
    return ranked.filter("g.strings > 0").select(*by, "s", "g.gram", "g.at")


def contained(inner: DataFrame, outer: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (by, s, whole): which strings of inner(by, s) stand in which of outer(by, s) with the same `by`; none of them empty.

    A string is looked up by its rarest gram among the postings (gram, place) of the other side, and
    compared at that place alone; strings shorter than a gram by themselves among all substrings of their
    length. Joins are on equal keys only.
    """
    by = by or []
    wholes = outer.select(*by, F.col("s").alias("whole"))
    postings = wholes.select(*by, "whole", F.posexplode(_grams(F.col("whole"))).alias("place", "gram"))
    # substring() counts from 1 and is never asked for a place before it
    begin = F.col("place") - F.col("at") + 1
    found = _rarest(inner.filter(F.length("s") >= GRAM), outer, by).join(postings, [*by, "gram"])
    out = found.filter((begin >= 1) & (F.substring(F.col("whole"), begin, F.length("s")) == F.col("s"))).select(*by, "s", "whole")
    for n in range(1, GRAM):
        pieces = wholes.select(*by, "whole", F.explode(F.array_distinct(_grams(F.col("whole"), n))).alias("s"))
        out = out.unionByName(inner.filter(F.length("s") == n).select(*by, "s").join(pieces, [*by, "s"]).select(*by, "s", "whole"))
    return out.distinct()


def overlapping(queries: DataFrame, titles: DataFrame, least: float = ACCEPT) -> DataFrame:
    """(ql, tl, score): queries(ql, tokens) and titles(tl, tokens) that share so great a part of a query's tokens.

    To share k of n tokens, two must share one of the n - k + 1 rarest; only these are joined on.
    """
    q = queries.select("ql", F.explode("tokens").alias("token"))
    t = titles.select("tl", F.explode("tokens").alias("token"))
    counts = t.join(q.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("titles"))
    ranked = q.join(counts, "token", "left").groupBy("ql").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "token"))).alias("r"))
    few = F.size("r") - F.ceil(F.lit(least) * F.size("r") - F.lit(1e-9)).cast("int") + 1
    keys = ranked.select("ql", F.explode(F.slice("r", F.lit(1), few)).alias("k")).filter("k.titles > 0").select("ql", F.col("k.token").alias("token"))
    pairs = keys.join(t, "token").select("ql", "tl").distinct()
    both = pairs.join(queries.select("ql", F.col("tokens").alias("a")), "ql").join(titles.select("tl", F.col("tokens").alias("b")), "tl")
    return both.select("ql", "tl", (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("score")).filter(F.col("score") >= least)


def resolve_titles(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, doc_id, rule, score) of queries(query_id, query) against titles(ord, doc_id, title).

    A query that is a doc_id finds it (rule 0). Else the first title (by ord) that contains the query
    or is contained in it wins (1; a title without text stands in any query); else the title with most of
    the query's tokens, the first of equals, from ACCEPT on (2); else the only title there is (3). Equal
    queries and equal titles are compared once.
    """
    q = written(queries.select("query_id", "query", X.collapse_ws(F.lower(F.coalesce("query", F.lit("")))).alias("ql")))
    t = written(titles.select("ord", "doc_id", "title", F.lower(F.coalesce("title", F.lit(""))).alias("tl")))
    place = F.struct("ord", "doc_id")

    same = q.join(t.select("ord", "doc_id", F.col("doc_id").cast("string").alias("query")), "query").groupBy("query_id").agg(F.min(place).alias("p")).select("query_id", "p", F.lit(0).alias("rule"), F.lit(1.0).alias("score"))

    first = written(t.groupBy("tl").agg(F.min(place).alias("p")))
    texts = q.filter("ql <> ''").select("ql").distinct()
    named = first.filter("tl <> ''")
    stands = contained(texts.select(F.col("ql").alias("s")), named.select(F.col("tl").alias("s"))).select(F.col("s").alias("ql"), F.col("whole").alias("tl"))
    holds = contained(named.select(F.col("tl").alias("s")), texts.select(F.col("ql").alias("s"))).select(F.col("whole").alias("ql"), F.col("s").alias("tl"))
    hits = stands.unionByName(holds).join(first, "tl").select("ql", "p")
    anything = texts.crossJoin(F.broadcast(first.filter("tl = ''").select("p")))  # one row at most
    hit = written(hits.unionByName(anything).groupBy("ql").agg(F.min("p").alias("p")))
    hit = q.join(hit, "ql").select("query_id", "p", F.lit(1).alias("rule"), F.lit(1.0).alias("score"))

    tokens = lambda rows, column, name: rows.groupBy(name).agg(F.first(X.title_tokens(F.col(column))).alias("tokens")).filter(F.size("tokens") > 0)
    scored = overlapping(tokens(q, "query", "ql"), tokens(t, "title", "tl")).join(first, "tl")
    best = scored.groupBy("ql").agg(F.min(F.struct((-F.col("score")).alias("minus"), "p")).alias("b"))
    near = q.join(best, "ql").select("query_id", F.col("b.p").alias("p"), F.lit(2).alias("rule"), (-F.col("b.minus")).alias("score"))

    found = same.unionByName(hit).unionByName(near)
    if t.limit(2).count() == 1:  # then the two sides are few enough for this one row
        overlap = F.coalesce(X.token_overlap(F.col("query"), F.col("title")), F.lit(0.0))
        found = found.unionByName(q.crossJoin(F.broadcast(t.drop("tl"))).select("query_id", place.alias("p"), F.lit(3).alias("rule"), overlap.alias("score")))
    out = found.groupBy("query_id").agg(F.min(F.struct("rule", "p", "score")).alias("b"))
    return out.select("query_id", F.col("b.p.doc_id").alias("doc_id"), F.col("b.rule").alias("rule"), F.col("b.score").alias("score"))


def passage_blocks(blocks: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (key, passage, block): which blocks of a document show which of its passages, by passage_hit().

    blocks(key, block, text), passages(key, passage, text). Both branches of the rule are containments
    within a document and looked up by postings; no block meets a passage with which it shares no gram.
    """
    b = blocks.select(key, "block", X.passage_form(F.col("text")).alias("form")).filter(F.length("form") >= X.LEAST_BLOCK)
    p = passages.select(key, "passage", X.passage_form(F.col("text")).alias("form"), X.passage_needle(F.col("text")).alias("needle"))
    forms = lambda rows, column: rows.select(key, F.col(column).alias("s")).filter("s <> ''").distinct()
    inside = contained(forms(b, "form"), forms(p, "form"), [key]).select(key, F.col("s").alias("b"), F.col("whole").alias("p"))
    around = contained(forms(p, "needle"), forms(b, "form"), [key]).select(key, F.col("whole").alias("b"), F.col("s").alias("n"))
    names = b.select(key, "block", F.col("form").alias("b"))
    first = inside.join(names, [key, "b"]).join(p.select(key, "passage", F.col("form").alias("p")), [key, "p"])
    second = around.join(names, [key, "b"]).join(p.select(key, "passage", F.col("needle").alias("n")), [key, "n"])
    return first.select(key, "passage", "block").unionByName(second.select(key, "passage", "block")).distinct()
