"""Operator 5, URL filters: a bit-parallel wildcard automaton (Shift-And over several words).

Every glob rule is a row of states, one bit each, packed behind each other into 64-bit words. One
step moves all states of all rules over one byte: shifted states that the byte allows, and states
behind a star, which any byte keeps. The step is done for many URLs at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow, table

#: The contract's rules: verdict, host and path beginning.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The method's own globs over host#path, for URLs that no rule fits; what they don't match is allowed.
BLOCKED_GLOBS = ("*spam-*#*", "*cheap-pills*#*", "*free-bets*#*", "*casino*#*", "*.ads-*#*", "*.ads.*#*", "*.adserver.*#*", "*.doubleclick.*#*")

_LOWER = str.maketrans(UPPER, LOWER)
#: URLs that are stepped together; bytes above which a URL is stepped by itself.
TOGETHER, LONG = 4096, 1024


class GlobSet:
    """Globs with * (any run of bytes) and ? (any byte), matched against whole byte strings."""

    def __init__(self, globs: Sequence[str]):
        bits = []  # (byte or None for any, star behind it); the first of each glob is its start
        self.starts, self.ends = [], []
        for glob in globs:
            self.starts.append(len(bits))
            bits.append([-1, False])
            for b in glob.encode():
                if b == 0x2A:
                    bits[-1][1] = True
                else:
                    bits.append([None if b == 0x3F else b, False])
            self.ends.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.allowed = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for i, (byte, star) in enumerate(bits):
            bit = np.uint64(1 << (i % 64))
            if byte is None:
                self.allowed[:, i // 64] |= bit
            elif byte >= 0:
                self.allowed[byte, i // 64] |= bit
            if star:
                self.stay[i // 64] |= bit
        for i in self.starts:
            self.first[i // 64] |= np.uint64(1 << (i % 64))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text and glob, whether the glob matches the whole text."""
        long = [i for i, t in enumerate(texts) if len(t) > LONG]
        if long:
            short = self.match([b"" if len(t) > LONG else t for t in texts])
            for i in long:
                short[i] = self._match_long(texts[i])
            return short
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")  # the longest first: those at work stay in front
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
        state = np.tile(self.first, (n, 1))
        working = n
        for step in range(int(lengths.max(initial=0))):
            while working and lengths[order[working - 1]] <= step:
                working -= 1
            now = state[:working]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.allowed[data[at[:working] + step]]
            now &= self.stay
            now |= moved
        out = np.zeros((n, len(self.ends)), bool)
        for g, i in enumerate(self.ends):
            out[order, g] = (state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
        return out


    def _match_long(self, text: bytes) -> np.ndarray:
        """The same steps for one text, with all words of a state as one number."""
        whole = lambda words: int.from_bytes(np.ascontiguousarray(words, "<u8").tobytes(), "little")
        allowed, stay, state = [whole(row) for row in self.allowed], whole(self.stay), whole(self.first)
        for b in text:
            state = (state << 1) & allowed[b] | state & stay
            if not state:
                break
        return np.array([bool(state >> i & 1) for i in self.ends])


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as they stand in a URL; both empty without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path_end = min((i for i in (rest.find("?", host_end), rest.find("#", host_end)) if i >= 0), default=len(rest))
    return rest[:host_end].translate(_LOWER), rest[host_end:path_end]


def _literal(text: str) -> str:
    if "*" in text or "?" in text:
        raise ValueError("a host and path rule has no wildcards")
    return text


def rule_glob(rule: str) -> str:
    """The glob of a host and path rule over "." + host + "#" + path: the host, its subdomains, the path's beginning."""
    host, slash, path = rule.partition("/")
    return f"*.{_literal(host)}#{slash}{_literal(path)}*"


def filter_urls(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, blocked_globs=BLOCKED_GLOBS) -> DataFrame:
    """keep, host, path, rule, verdict for every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting
    rule wins, the earlier one of two as long. Where none fits, rule is null and the verdict is block
    if one of blocked_globs matches, else allow. A null URL or one without "://" has an empty host
    and path. Every one of repeated rows is judged; an empty table gives no rows; other columns don't
    matter. URLs of any length are judged whole.
    """
    rules, blocked_globs = tuple(rules), tuple(blocked_globs)
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = GlobSet([*(rule_glob(rules[i][1]) for i in ranked), *blocked_globs])
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                parts = [split_url(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
                hit = globs.match([f".{h}#{p}".encode() for h, p in parts])
                by_rule, by_glob = hit[:, : len(rules)], hit[:, len(rules) :].any(axis=1)
                first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if len(rules) else np.full(len(parts), -1)
                names, verdicts = [], []
                for k, blocked in zip(first.tolist(), by_glob.tolist(), strict=True):
                    names.append(rules[ranked[k]][1] if k >= 0 else None)
                    verdicts.append(rules[ranked[k]][0] if k >= 0 else "block" if blocked else "allow")
                arrays = [*batch.columns[:-1], pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "host", "path", "rule", "verdict"])

    chosen = pages.select(*keep, F.col(url).alias("__url"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return arrow(chosen, run, f"{schema}, host string, path string, rule string, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rules = ", ".join(f"({i}, '{v}', '{r}', '.{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for i, (v, r) in enumerate(RULES))
    globs = " OR ".join(f"'.' || host || '#' || path LIKE '{g.replace('*', '%')}'" for g in BLOCKED_GLOBS)
    return rf"""
WITH rules(n, verdict, rule, host, path) AS (VALUES {rules}),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), m AS (
  SELECT page_id, host, path,
         (SELECT min_by(struct_pack(rule := k.rule, verdict := k.verdict), -100000 * len(k.rule) + k.n) FROM rules k
          WHERE ends_with('.' || p.host, k.host) AND starts_with(p.path, k.path)) AS won
  FROM p
)
SELECT page_id, host, path, won.rule AS rule, coalesce(won.verdict, CASE WHEN {globs} THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""


SQL = _sql()
