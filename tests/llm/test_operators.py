"""Operators against plain versions of themselves."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import DATA, duck
from pyspark.sql import functions as F

from quillgraph.llm import common, exact_dedup, fingerprints, html_extract, license_scan, mixing, near_dedup, packing, token_counts, toxicity, url_filter, words

LOWER = str.maketrans(common.UPPER, common.LOWER)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


# 1


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.Unigram([*token_counts.load_vocabulary(token_counts.vocabulary_path())], unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return plain


def test_token_counts_equal_a_unigram_tokenizer(spark, documents):
    random.seed(1)
    odd = ["", " ", "  a", "a b ", "\n\nx", "a\n b", "é一😀x 😀", "a▁b ▁", "<s> <0x41>", "\t\tx", None, "ß\x00\x01"]
    odd += ["".join(random.choice(" \nab▁é😀的<0x1>") for _ in range(random.randrange(40))) for _ in range(150)]
    texts = odd + documents["text"].tolist()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_counts.count_tokens(rows).toPandas().set_index("doc_id")["n_tokens"]
    plain = unigram()
    assert [found[i] for i in range(len(texts))] == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_cut_texts(monkeypatch, documents):
    texts = pa.array(documents["text"].tolist()[:60] + ["  a \n b  ", " x", "y "])
    whole = token_counts.Batch(token_counts.vocabulary_path())(texts)
    monkeypatch.setattr(token_counts, "slices", lambda d, o, c: common.slices(d, o, c, 30))
    cut = token_counts.Batch(token_counts.vocabulary_path())(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_long_words_and_texts(monkeypatch):
    monkeypatch.setattr(common.slices, "__defaults__", (50,))
    for module in (token_counts, words):
        monkeypatch.setattr(module, "SLICE_BYTES", 50)
    texts = ["x" * 400, "y" * 333 + " tail", "head " + "é" * 200 + "\nend", " " + "z" * 150, "ab " * 100]
    found = token_counts.Batch(token_counts.vocabulary_path())(pa.array(texts))[0].tolist()
    plain = unigram()
    assert found == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    data = np.frombuffer(("w" * 300).encode(), np.uint8)
    one = words.hashes(data, np.array([7]), np.array([300]))
    monkeypatch.setattr(words, "SLICE_BYTES", 1 << 20)
    assert one.tolist() == words.hashes(data, np.array([7]), np.array([300])).tolist()


# 2


def test_peeling_recovers_all_differences():
    rng = np.random.default_rng(0)
    pairs = []
    for n in (0, 1, 5, 40, 700):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(3))
        pairs.append((np.concatenate([both, a]), np.concatenate([both, b[: n // 2]])))
        pairs.append((both, both))
    for (a, b), (only_a, only_b, _) in zip(pairs, fingerprints.differences(pairs), strict=True):
        assert sorted(only_a.tolist()) == sorted(set(a.tolist()) - set(b.tolist()))
        assert sorted(only_b.tolist()) == sorted(set(b.tolist()) - set(a.tolist()))


def plain_paragraphs(text: str) -> Counter:
    """Lines, cut at sentence ends and then every six words; words as their UTF-8 bytes."""
    out = Counter()
    for line in text.split("\n"):
        run = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            run.append(word)
            if word[-1] in ".!?" or len(run) == fingerprints.PARAGRAPH_WORDS:
                out[tuple(run)] += 1
                run = []
        if run:
            out[tuple(run)] += 1
    return out


def check_fingerprints(found: pd.DataFrame, rows: list[tuple[int, str]]) -> None:
    """Likeness against plain paragraphs: of equal ones as many are common as both have."""
    found, rows = found.set_index("doc_id"), sorted(rows)
    by_text = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert found.n_chars[i] == len(text) and found.edited_sha256[i] == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, found.fingerprint[i]) == found.fingerprint[i]
        own = plain_paragraphs(text)
        for column, other in (("near_next", plain_paragraphs(following)), ("near_edited", plain_paragraphs(changed))):
            every = (own | other).total()
            assert found[column][i] == pytest.approx((own & other).total() / every if every else 1)
        (n,), sketch = fingerprints.to_sketches([found.fingerprint[i]])
        assert n == own.total() and sketch.texts([n]) == [found.fingerprint[i]]


def test_fingerprints(spark, documents):
    found = fingerprints.op2_fingerprints(spark, DATA).toPandas()
    check_fingerprints(found, list(zip(documents["doc_id"], documents["text"], strict=True)))
    assert (found.near_edited > found.near_next).mean() > 0.95
    # what the fingerprints tell by themselves
    _, own = fingerprints.to_sketches(found.fingerprint.tolist())
    _, edited = fingerprints.to_sketches(found.edited_fingerprint.tolist())
    assert ((own.minus(edited).peel()[3]) == (found.cells_edited == fingerprints.CELLS)).all()


def test_fingerprints_of_far_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_ROWS", 20)
    texts = documents["text"].tolist()
    rows = [(i, t) for i, t in enumerate(texts)] + [(2**60 + i, t) for i, t in enumerate(texts[:50])] + [(-(2**62), texts[3]), (2**62 + 5, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [r["count"] for r in fingerprints.with_next(docs, "text", "doc_id").filter("guard = 0").groupBy("part").count().collect()]
    assert sum(parts) == len(rows) and max(parts) <= 40
    check_fingerprints(fingerprints.fingerprint_versions(docs).toPandas(), rows)


# 3


def test_mixing_comes_near_its_targets(spark):
    rows = mixing.op3_mix_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert (rows.taken <= 3 * rows["size"]).all()
    by_source = rows.groupby(["source_size", "target"]).agg(taken=("taken", "sum")).reset_index()
    assert ((by_source.taken - by_source.target).abs() / by_source.target).max() < 0.05


def test_targets_stop_at_three_times(spark):
    sources = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 1000), (None, 10), ("e", 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    # weights by code point, null last: a 5, b 2, c 1, e 5, null 2
    assert found["a"] == 3 and found["e"] == 0 and found[None] == 30
    assert found["b"] == pytest.approx(2 * (2011 - 33) / 3) and found["c"] == pytest.approx((2011 - 33) / 3)


def test_every_document_is_drawn_by_its_fraction(spark):
    # one source of 400 documents of about the same size at a rate of 0.625: over many seeds, each is drawn so often
    docs = spark.createDataFrame([(i, "w " * (20 + i % 5), "a" if i < 400 else "b") for i in range(640)], "doc_id long, text string, source string")
    drawn = np.zeros(640)
    for seed in range(6):
        found = mixing.copies(docs, weights=(1, 1), seed=seed).toPandas().sort_values("doc_id")
        drawn += found["copies"].to_numpy()
        by_source = found.assign(taken=found["copies"] * found["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        assert ((by_source.taken - by_source.target).abs() / by_source.target).max() < 0.01
    for rate, part in ((0.8, drawn[:400] / 6), (4 / 3, drawn[400:] / 6)):
        assert abs(part.mean() - rate) < 0.02 and abs(part.std() - math.sqrt((rate % 1) * (1 - rate % 1) / 6)) < 0.03


def test_mix_keeps_repeated_rows_apart(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e f g", "s"), (3, None, None)] + [(10 + i, "x " * (1 + i % 7), "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = mixing.copies(docs).groupBy("doc_id").sum("copies").filter("`sum(copies)` > 0").collect()
    got = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in wanted} == {r[0]: r[1] for r in got}


def test_mix_emits_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2], i) for i in range(200)], "doc_id long, text string, source string, __copies int")
    wanted = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {i: n for i, n in wanted.items() if n}


# 4


def test_folding():
    assert toxicity.fold("1D10T! mоrоn m0r0n you$tupid").split() == ["idiot", "moron", "moron", "youstupid"]
    lexicon = toxicity.Lexicon({" trash": 2.0, " idiot ": 3.0})
    assert lexicon.weight(toxicity.fold("Put it in the trash can.")) == 0
    assert lexicon.weight(toxicity.fold("trash, trash can, IDI0T idiotic")) == 5


def test_exceptions_in_linear_time_and_over_cuts(monkeypatch):
    lexicon = toxicity.Lexicon({" trash": 2.0, " moron ": 3.0})
    began = time.time()
    assert lexicon.weight(toxicity.fold("trash can trash now " * 50_000)) == 100_000
    assert time.time() - began < 5
    text = "a trash can moron trash bags trash x " * 30
    whole = lexicon.weight(toxicity.fold(text))
    for limit in (7, 13, 40, 200):
        monkeypatch.setattr(toxicity, "slices", lambda d, o, c, n=limit: common.slices(d, o, c, n))
        weight, _ = toxicity.Weigher(lexicon)(pa.array([text, "fine"]))
        assert weight.tolist() == [whole, 0]


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    rows = toxicity.op4_toxicity(spark, data).toPandas().merge(spark.read.parquet(f"{data}/labels.parquet").toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).all()
    toxic = held.toxic == 1
    assert (held.predicted[toxic] == 1).mean() > 0.85 and (held.predicted[~toxic] == 0).mean() > 0.98
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "hello there"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, lexicon).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r["doc_id"] for r in toxicity.clean(docs, lexicon).collect()} == {2, 3}


# 5


def test_globs_equal_regular_expressions():
    random.seed(3)
    globs = ["".join(random.choice("ab*?/") for _ in range(random.randrange(9))) for _ in range(60)]
    texts = ["".join(random.choice("ab/") for _ in range(random.randrange(12))) for _ in range(300)]
    found = url_filter.GlobSet(globs).match([t.encode() for t in texts])
    for g, glob in enumerate(globs):
        plain = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)
        assert [bool(plain.fullmatch(t)) for t in texts] == found[:, g].tolist()


# 6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">Cookies!</div><div id="sidebar">Side</div>
<main><article class="post"><header class="entry-header"><h1>{title}</h1></header><p class="share-this">Share</p><p class="note">Same everywhere</p>{body}
<form><input>Go</form><div class="ad-slot">Buy</div><section id="comments"><article class="comment">nice</article></section></article><aside>x</aside></main><footer>f</footer>"""


def test_long_urls_are_judged_alike():
    globs = url_filter.GlobSet(["*.a#/x*", "*b?c*", "*" + "d" * 70 + "*", ""])
    texts = [b"." + b"q" * n + b".a#/x" + b"b_c" * k + b"d" * 70 for n in (3, 2000, 100_000) for k in (0, 1)]
    found = globs.match([*texts, b""])
    assert found.tolist() == [[True, k == 1, True, False] for _ in range(3) for k in (0, 1)] + [[False, False, False, True]]


def test_main_text():
    page = PAGE.format(title="Title &amp; more", body="<p>One <b>two</b>\n three<p>Four&nbsp;five<ul><li>a<li>b</ul><script>no()</script>")
    assert html_extract.main_text(html_extract.parse(page)).split("\n") == ["Title & more", "Same everywhere", "One two three", "Four five", "a", "b"]
    assert html_extract.main_text(html_extract.parse("")) == ""
    assert html_extract.main_text(html_extract.parse("<div class=content><h2>Hi</h2>Text<br>more<p>para</div><ul class=menu><li>m</ul>")) == "Hi\nText more\npara"


def test_names_of_subjects_stay():
    text = lambda page: html_extract.main_text(html_extract.parse(page)).split("\n")
    for names in ("post category-reviews", "post tag-search", "teaser"):
        assert text(f'<nav>n</nav><article class="{names}"><p>Text</p></article>') == ["Text"]
    assert text('<div role="main" class="page search"><p>Text</p></div>') == ["Text"]
    subjects = '<section id="discussion">a</section><h2 id="related-work">b</h2><p class="legal">c</p><div id="response-time">d</div><section id="search-algorithms">e</section><section id="related">f</section>'
    assert text(f"<article>{subjects}</article>") == text(f"<main>{subjects}</main>") == list("abcdef")
    furniture = '<div class="ad">a</div><div class="top-ad-slot">b</div><div id="cookie-notice">c</div><div class="post-footer">d</div><div class="relatedPosts">e</div><section id="comments">f</section>'
    assert text(f"<article><p>Text</p>{furniture}</article>") == ["Text"]


def test_nothing_else_is_cut():
    text = lambda page: html_extract.main_text(html_extract.parse(page)).split("\n")
    for icon in ('<svg class="icon"/>', "<svg/>", '<svg title="a > b" />', "<svg><path d='M0'/><text>t</text></svg>", "<math/>", '<math display="block" />'):
        assert text(f"<article><p>Before {icon}and after</p><p>End</p></article>") == ["Before and after", "End"]
    assert text("<article><object-card>a</object-card><p>b</p><select-box>c</select-box><p>d</article>") == ["a", "b", "c", "d"]
    assert text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object data=f><b>bold</b></object></p></article>") == ["So x=1 and bold"]
    assert text('<main><h1>Title</h1><p>body</p><article class="card">card</article><aside>x</aside><p>end</p></main>') == ["Title", "body", "card", "end"]
    plain = '<div><a href="/">Home</a> | <a href="/b">B</a></div><h2><a href=/t>Linked title</a></h2><p>See <a href=/1>a long linked text</a>, <a href=/2>another linked text</a>.</p><ul><li><a href=/3>Item</a></ul>'
    assert text(plain) == ["Linked title", "See a long linked text, another linked text."]


def test_constants_of_a_host_go(spark):
    pages = [(i, f"http://h.org/{i}", PAGE.format(title=f"T{i}", body=f"<p>body {i}" * (1 + i % 3))) for i in range(8)] + [(99, "http://alone.org/", PAGE.format(title="T", body="<p>b"))]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[0] == "T0\nbody 0" and found[4] == "T4\nbody 4\nbody 4"
    assert found[99] == "T\nSame everywhere\nb"


def test_constants_of_an_article_stay(spark):
    page = '<article><h1>T{0}</h1><p>Shared lead</p><h2 class="note">Summary</h2><p>body {0}</p><p class="legal">CC BY</p><p class="promo-note">Buy</p></article>'
    pages = [(i, f"http://h.org/{i}", page.format(i)) for i in range(8)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {i: f"T{i}\nShared lead\nSummary\nbody {i}\nCC BY" for i in range(8)}


def test_alignment():
    one, two = (html_extract.page_wrapper(html_extract.parse(h)) for h in ("<ul><li>a<li>b</ul><p>x</p>", "<ul><li>a</ul><hr><p>y</p>"))
    merged = html_extract._merge(one, two)
    assert [(x[0], x[1], x[2]) for x in merged[3]] == [("ul", False, False), ("hr", False, True), ("p", False, False)]
    assert merged[3][0][3][0][1] is True and merged[3][2][3][0] == ["#", 2, None, 2]


class Site:
    """A host of made-up pages: a template with names that mean nothing (or mislead), content that varies, chrome around it."""

    def __init__(self, rng: random.Random, semantic: bool):
        self.rng, self.semantic = rng, semantic
        name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
        self.names = [name() for _ in range(12)]
        self.words = [name() for _ in range(300)]
        self.article = rng.choice(["post comments-open", "post category-reviews", "tag-search", "has-sidebar", name()])
        self.links = [self.text(1, 2) for _ in range(rng.randrange(3, 9))]
        self.about, self.depth = self.text(5, 30), rng.randrange(4)

    def text(self, least: int, most: int) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randrange(least, most)))

    def page(self) -> tuple[str, str]:
        title, paragraphs = self.text(2, 9), [self.text(20, 90) for _ in range(self.rng.randrange(2, 9))]
        body = "".join(f"<p>{p}" if self.rng.random() < 0.5 else f"<p>{p}</p>" for p in paragraphs)
        n = self.names
        inner = f'<h1>{title}</h1>{body}<div class="ad">{self.text(3, 8)}</div>'
        if self.semantic:
            inner = f'<article class="{self.article}">{inner}<section id="comments">{self.text(5, 60)}</section></article>'
        else:
            inner = f'<div class="{n[0]}">{inner}</div>'
        for k in range(self.depth):
            inner = f'<div class="{n[1 + k]}">{inner}</div>'
        menu = "".join(f'<li><a href="/{k}">{t}</a>' for k, t in enumerate(self.links))
        teasers = "".join(f'<div class="{n[8]}"><a href="/t">{self.text(4, 12)}</a></div>' for _ in range(self.rng.randrange(5)))
        page = f'<html><head><title>{title}</title></head><body><div class="{n[9]}"><ul>{menu}</ul></div><div class="{n[10]}">{inner}<div class="{n[11]}">{teasers}<p>{self.about}</p></div></div><footer>{self.text(2, 9)}</footer>'
        return page, "\n".join([title, *paragraphs])


def test_generated_sites(spark):
    rng, rows, wanted = random.Random(8), [], {}
    for host in range(24):
        site = Site(rng, host % 2 == 0)
        for _ in range(1 + host % 9 if host % 2 == 0 else rng.randrange(3, 12)):
            page, wanted[len(rows)] = site.page()
            rows.append((len(rows), f"http://h{host}.org/", page))
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert found == wanted


def test_many_siblings_and_levels():
    many = "".join(f'<div class="k{"abcdefghij"[i % 10]}{"klmnopqrst"[i // 10 % 10]}x">{i}</div><p>{i}' for i in range(20_000))
    one, two = (html_extract.page_wrapper(html_extract.parse(f"<article>{h}</article>")) for h in (many, many[200:] + "<hr>"))
    merged = html_extract._merge(one, two)
    assert len(merged[3][0][3]) <= html_extract.WIDEST
    assert html_extract.main_text(html_extract.parse(f"<article>{many}</article>")).count("\n") == 39_999
    deep = "<div>" * 5000 + "<form>no<div>no</div></form><p>yes</p>" + "</i></div>" * 5000
    assert html_extract.main_text(html_extract.parse(f"<main>{deep}<p>end</main>")) == "yes\nend"


def test_long_lists_are_aligned():
    rng = random.Random(3)
    a = [[f"t{rng.randrange(5)}.u{i}" if i % 3 else "p", False, False, []] for i in range(3000)]
    b = [x for x in a if rng.random() < 0.9]
    pairs = html_extract._matches(a, b)
    assert all(a[i][0] == b[j][0] for i, j in pairs) and all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))
    assert len(pairs) > 0.97 * len(b)
    repeated = [["p", False, False, []], ["div", False, False, []]] * 1500
    assert len(html_extract._matches(repeated, repeated[1:] + repeated[:1])) > 2900


# 7


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_encoder_equals_the_tokenizer(documents):
    random.seed(2)
    odd = ["", " ", "a\x1cb", "x\xa0y\x85z  q", "it's they'RE ΑΣ ΣΑΣ. İI é", "<|endoftext|> a", "\n\n", "'s's ''tt !!'s", "的漢字 😀😁", "\x00a\x7f", "½²³ ٣"]
    odd += ["".join(random.choice(" 'stré\u0301ÀΣ的1!_\n\x1c😀") for _ in range(40)) for _ in range(200)]
    texts = odd + documents["text"].tolist()
    plain = tokenizer()
    for text, ids in zip(texts, packing.Encoder(packing.tokenizer_path())(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_round_trip(spark, documents):
    pieces = packing.op7_best_fit_packing(spark, DATA).toPandas()
    plain = tokenizer()
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in zip(documents.doc_id, documents.text, strict=True)}
    for i, own in pieces.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [4096 * k for k in range(len(own))] and own.length.sum() == len(ids[i])
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
    assert set(pieces.doc_id) == set(ids)
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert pieces.sequence_id.nunique() <= 1.03 * pieces.length.sum() / 4096 + 1


def test_best_fit_is_bounded():
    packer = packing.Packer(10, 2)
    assert [packer.put(n)[0] for n in (6, 7, 3, 4, 9, 8)] == [0, 1, 1, 0, 2, 3]
    packer = packing.Packer(10, 2)
    for n in (6, 7, 8):  # a third bin closes the fullest
        packer.put(n)
    assert set(packer.left_open()) == {0, 2}


# 8


def plain_components(texts: dict[int, str | None], width: int, percent: int) -> tuple[dict[int, int], dict[int, int]]:
    sets, parent = {}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in texts}


@pytest.mark.parametrize(("block", "run"), [(near_dedup.BLOCK, near_dedup.RUN), (3, near_dedup.RUN), (near_dedup.BLOCK, 3)])
def test_near_components(spark, block, run):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randrange(3, 60)) for _ in range(12)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: "one", 3: "ONE", 4: "one two three"}
    for i in range(5, 160):  # families whose likeness lies around the threshold
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(w) // 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i] = " ".join(w)
    sizes, wanted = plain_components(texts, 4, 80)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_components(rows, width=4, block=block, run=run).toPandas().set_index("doc_id")
    assert found.n_shingles.to_dict() == sizes and found.component_id.to_dict() == wanted
    assert (found.kept == (found.index == found.component_id)).all()


def test_long_runs_go_by_in_pieces():
    rng = np.random.default_rng(11)
    for _ in range(60):
        keys = np.repeat(np.arange(12), rng.choice([0, 1, 2, 5, 40, 90], 12)) - 3
        cuts = np.sort(rng.integers(0, len(keys) + 1, rng.integers(0, 9)))
        parts = [p for p in np.split(keys, cuts)]
        batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(np.arange(len(p)), pa.int64())], ["k", "id"]) for p in parts]
        found = [(batch.column(0).to_numpy(), long) for batch, long in near_dedup.short_runs(iter(batches), 20)]
        assert sum((k.tolist() for k, _ in found), []) == keys.tolist()
        longest = max((len(p) for p in parts), default=0)
        for k, long in found:
            assert len(k) and len(k) <= 20 + longest
            if long:
                assert len(set(k)) == 1 and (keys == k[0]).sum() > 20
            else:  # whole runs
                assert all((k == x).sum() == (keys == x).sum() for x in set(k))


def test_signatures_share_a_key_within_the_distance():
    rng = np.random.default_rng(7)
    one = rng.integers(0, 1 << 32, (200, near_dedup.KEY_SLOTS), dtype=np.uint32)
    two = one.copy()
    for row in two:
        changed = rng.choice(near_dedup.KEY_SLOTS, rng.integers(0, near_dedup.MAX_DISTANCE + 1), replace=False)
        row[changed] ^= np.uint32(1)
    a, b = near_dedup.signature_keys(one), near_dedup.signature_keys(two)
    assert (a == b).any(axis=1).all()


def test_packed_signatures_differ_in_as_many_places():
    rng = np.random.default_rng(8)
    one, two = rng.integers(0, 1 << 32, (2, 50, near_dedup.SLOTS), dtype=np.uint32)
    plain = ((one & 3) != (two & 3)).sum(axis=1)
    assert (near_dedup.far_apart(near_dedup.packed(one), near_dedup.packed(two)) == plain).all()


def test_rows_of_one_key_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (9, a + " more"), (9, "quite another text of a few words"), (7, None), (7, b), (None, a)], "doc_id long, text string")
    left = near_dedup.drop_near(rows, width=4).collect()
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:9]) for r in left) == sorted([(5, a[:9]), (5, b[:9]), (9, "quite ano"), (7, ""), (-1, a[:9])])


def test_a_large_family_without_links_is_pruned(spark):
    core = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join([*core, *(f"u{i}x{k}" for k in range(50))])) for i in range(600)] + [(1000, " ".join([*core, *(f"u7x{k}" for k in range(45))]))]
    found = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), width=4).toPandas().set_index("doc_id")
    assert found.component_id[1000] == 7 and (found.component_id.drop(1000) == found.index.drop(1000)).all()


# 9


def test_license_scan(spark):
    texts = ["MIT License MIT-license", "Licensed under CC BY-NC 4.0.", "apache licensed", "see the GNU General Public License, version 3", None, "mit\n\nLICENSE!", "permission is hereby granted", "Licence mit license2"]
    found = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(found[i]["n_base"], found[i]["first_word"], found[i]["last_word"], found[i]["base_labels"]) for i in range(8)] == [
        (2, 0, 2, "mit"), (0, None, None, ""), (0, None, None, ""), (1, 3, 3, "gpl"), (0, None, None, ""), (1, 0, 0, "mit"), (0, None, None, ""), (0, None, None, "")
    ]
    assert found[1]["labels"] == "cc-by-nc-4.0" and found[4]["n_words"] == 0


def test_license_scan_of_other_phrases_and_templates(spark):
    texts = ["foo bar and zip zap", "Foo, bar! foo bar", "quite other words that stand here in a row", "nothing", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    row = "quite other words that stand here in a row"
    own = [("own", row, ["other words"]), ("keyless", "nothing", [])]
    found = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in license_scan.scan(docs, base={"foo bar": "fb", "zip zap": "zz"}, templates=own).collect()}
    assert found == {0: (2, 0, 3, "fb,zz"), 1: (2, 0, 2, "fb"), 2: (0, None, None, "own"), 3: (0, None, None, "keyless"), 4: (0, None, None, "")}
    one = {r["doc_id"]: r["n_base"] for r in license_scan.scan(docs, base={"foo bar": "fb"}).collect()}
    assert one == {0: 1, 1: 2, 2: 0, 3: 0, 4: 0} and license_scan.scan(docs, base={}).agg(F.sum("n_base")).first()[0] == 0
    assert license_scan.gates([["a", "license"], ["mit", "license"], ["warranty"]]) == ["license", "warranty"] and license_scan.gates([[]]) is None


def test_license_scan_of_whole_texts(spark):
    templates = [(label, " ".join(text.split()), keys) for label, text, keys in license_scan.TEMPLATES]
    gates = license_scan.gates([[w for key in keys for w in key.split()] for _, _, keys in templates])
    assert all(any(g in key for key in keys for g in gates) for _, _, keys in templates)
    bsd = next(t for label, t, _ in templates if label == "bsd-2-clause")
    whole = [t if label != "bsd-3-clause" else bsd[: bsd.index("THIS SOFTWARE")] + t for label, t, _ in templates]
    every = "\n".join(whole)
    rows = [(0, "word " * 300_000 + every), *((n, f"/* {t} */ and nothing else. " + "more text " * 50) for n, t in enumerate(whole, 1)), *((100 + n, "some other text") for n in range(60))]
    found = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label for label, _, _ in templates} <= set(found[0])
    assert all(templates[n - 1][0] in found[n] for n in range(1, len(whole) + 1))
    assert found[100] == [""]


# 10


def test_exact_groups_keep_either_end(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, "")], "doc_id long, text string")
    for keep, ends in (("min", [1, 1, 3, 4, 5, 5]), ("max", [2, 2, 3, 4, 6, 6])):
        found = exact_dedup.exact_groups(rows, keep=keep).toPandas().sort_values("doc_id")
        assert found.keep_id.tolist() == ends and found.kept.tolist() == [i == e for i, e in zip(range(1, 7), ends, strict=True)]


def test_exact_groups_over_several_runs(spark, monkeypatch):
    seen = []
    plain = exact_dedup.DigestIndex.hits
    monkeypatch.setattr(exact_dedup.DigestIndex, "hits", lambda self: (seen.append([len(level) for level in self.levels]), plain(self))[1])
    rng = random.Random(4)
    rows = [(i, f"{rng.choice('ab')} text {rng.randrange(120)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = defaultdict(list)
    for i, t in rows:
        wanted[t].append(i)
    for memtable, fanin in ((1000, 8), (20, 8), (20, 3), (7, 2)):
        found = exact_dedup.exact_groups(docs, memtable=memtable, fanin=fanin).toPandas().set_index("doc_id")
        assert found.keep_id.to_dict() == {i: min(wanted[t]) for i, t in rows} and found.group_size.to_dict() == {i: len(wanted[t]) for i, t in rows}
    assert seen[0] == [1] and sum(seen[1]) > 1 and len(seen[2]) > 1 and len(seen[3]) > 2


def test_filters_let_no_member_out(spark):
    rows = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), (F.col("id") % 3).cast("int").alias("run"))
    found = exact_dedup.Filters(rows).probe(rows).filter("maybe").count(), exact_dedup.Filters(rows).probe(rows, F.col("run")).filter("maybe").count()
    assert found[0] == 3000 and found[1] < 600


def test_dropping_copies_by_key_and_text(spark):
    rows = spark.createDataFrame([(5, "A", "x"), (5, "B", "x"), (9, "a", "y"), (9, "a", "y"), (None, "b", "z"), (2, "b", "w")], "doc_id long, text string, lang string")
    left = exact_dedup.drop_copies(rows, keep="max").collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left) == [(-1, "b"), (5, "B"), (9, "a")]


def test_exact_groups_survive_a_digest_clash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: exact_dedup.F.lit("the same"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b")], "doc_id long, text string")
    found = exact_dedup.exact_groups(rows).toPandas().set_index("doc_id")
    assert found.keep_id.to_dict() == {1: 1, 2: 2, 3: 1, 4: 2}


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, data, "documents")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.toPandas(), common.saved(stage(spark, docs, data))
        after = docs.toPandas()
        left.append(after)
        if name == "packing":
            assert sorted(after[after.piece == 0].doc_id) == sorted(before.doc_id)
        else:
            assert list(after.columns) == list(before.columns) and set(after.doc_id) <= set(before.doc_id)
    groups = defaultdict(list)
    for i, t in zip(left[0].doc_id, left[0].text, strict=True):
        groups[t.translate(LOWER)].append(i)
    assert sorted(left[1].doc_id) == sorted(max(g) for g in groups.values())
    _, wanted = plain_components(dict(zip(left[1].doc_id, left[1].text, strict=True)), 5, 80)
    assert sorted(left[2].doc_id) == sorted(i for i, c in wanted.items() if i == c)
    # mixing: each document as often as the SQL of the contract takes its words
    taken = duck(mixing.SQL, documents=left[2])
    often = Counter(left[3].doc_id)
    assert {i: often[i] * n for i, n in zip(taken.doc_id, taken["size"], strict=True)} == dict(zip(taken.doc_id, taken.taken, strict=True)) and set(often) <= set(taken.doc_id)
    # all stages at once give the same pieces, whatever the sequences' numbers
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, data).toPandas()
    assert sorted(map(tuple, whole[pieces].to_numpy().tolist())) == sorted(map(tuple, left[4][pieces].to_numpy().tolist()))
    ends = whole.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all(g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= packing.SEQUENCE for _, g in ends)


@pytest.mark.parametrize("places", [1, 3, 16])
def test_packer_equals_plain_best_fit(places):
    """Bins in a list, each with its free space and when it got it; the fullest fitting one is taken, the last of equals."""
    random.seed(places)
    packer, bins, made = packing.Packer(100, places), [], 0
    for step in range(3000):
        length = random.choice([random.randint(1, 100), random.randint(1, 20), 100])
        fits = [b for b in bins if b[0] >= length]
        if fits:
            chosen = min(fits, key=lambda b: (b[0], -b[1]))
            bins.remove(chosen)
        else:
            if len(bins) == places:
                bins.remove(min(bins, key=lambda b: (b[0], -b[1])))
            chosen, made = (100, 0, made), made + 1
        free = chosen[0] - length
        assert packer.put(length) == (chosen[2], 100 - chosen[0])
        if free:
            bins.append((free, step, chosen[2]))
    assert packer.left_open() == {b[2]: b[0] for b in bins}
