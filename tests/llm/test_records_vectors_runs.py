"""Record files, whitening and periodic runs against plain versions of themselves."""

import hashlib
import json
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from awkward import LONG, awkward_pandas, write_tables
from helpers import DATA

from quillgraph.llm import periodic_runs, queries, records, whitening

# 11


def plain_ids(text):
    from tokenizers import Tokenizer

    global _tokenizer
    _tokenizer = globals().get("_tokenizer") or Tokenizer.from_file(records.tokenizer_path())
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_records_equal_the_tokenizer(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id")
    found = queries.QUERIES["op11_token_records"](spark, DATA).toPandas().set_index("doc_id")
    start = 0
    for key, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array(plain_ids(text), "<u4")
        assert tuple(found.loc[key, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_records_of_awkward_rows(spark, tmp_path):
    write_tables(tmp_path)
    found = queries.QUERIES["op11_token_records"](spark, str(tmp_path)).toPandas().sort_values("start")
    docs = awkward_pandas()["documents"]
    # the row without a key comes first, then ascending keys without gaps; repeated rows stand side by side
    keys = found["doc_id"].tolist()
    assert np.isnan(keys[0]) and keys[1:] == sorted(docs["doc_id"].dropna().tolist())
    assert found["start"].tolist() == [0, *found["n_tokens"].cumsum().tolist()[:-1]]
    crc = {k: zlib.crc32(np.array(plain_ids(t), "<u4").tobytes()) for k, t in zip(docs["doc_id"], docs["text"], strict=True) if pd.notna(k)}
    assert all(crc[k] == c for k, c in zip(found["doc_id"], found["ids_crc32"], strict=True) if k == k)


def test_round_trip_in_any_order(spark, tmp_path):
    random.seed(2)
    rows = [(k, " ".join(random.choice(["the", "model", "zebra", "été"]) for _ in range(random.randrange(30)))) for k in random.sample(range(10**9), 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "out")
    records.write_sequences(docs.repartition(5), folder)
    plain = [(k, plain_ids(t)) for k, t in sorted(rows)]
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in plain])[:-1]]).tolist()
    wanted = [(k, s, len(x), x) for (k, x), s in zip(plain, starts, strict=True)]
    assert sorted(map(tuple, records.read_sequences(spark, folder).collect()), key=lambda r: r[1]) == wanted
    one, again, other = ([tuple(r) for r in records.read_sequences(spark, folder, seed=s).collect()] for s in (5, 5, 6))
    assert one == again != other and one != wanted and sorted(one, key=lambda r: r[1]) == sorted(other, key=lambda r: r[1]) == wanted
    # small splits give the same rows
    small = spark.read.format(records.FORMAT).option("split", "500").load(folder)
    assert small.rdd.getNumPartitions() > 10 and sorted(map(tuple, small.collect()), key=lambda r: r[1]) == wanted
    with pytest.raises(Exception, match="holds sequences already"):
        records.write_sequences(docs, folder)
    records.write_sequences(docs.limit(3), folder, overwrite=True)
    assert records.read_sequences(spark, folder).count() == 3 and len(list((tmp_path / "out").glob("*.seq"))) <= 3


def test_shuffled_numbers_are_an_order():
    for n in (1, 2, 3, 10, 1000, 4097):
        found = records.shuffled(np.arange(n), n, 7)
        assert sorted(found.tolist()) == list(range(n))
    # neighbours don't stay neighbours
    assert (np.abs(np.diff(records.shuffled(np.arange(4097), 4097, 7))) < 3).sum() < 40


@pytest.mark.parametrize("place", [0, 9, 14, 30, -1])
def test_damage_is_found(spark, tmp_path, place):
    folder = tmp_path / "out"
    records.write_sequences(spark.createDataFrame([(1, "some text here"), (2, "more")], "doc_id long, text string").coalesce(1), str(folder))
    name = json.loads((folder / "manifest.json").read_text())["files"][0][0]
    raw = bytearray((folder / f"{name}.seq").read_bytes())
    raw[place] ^= 1
    (folder / f"{name}.seq").write_bytes(raw)
    with pytest.raises(Exception, match="checksum is wrong|cut off"):
        records.read_sequences(spark, str(folder)).collect()


def test_wide_ids_and_frames():
    for ids in ([], [1, 65_535], [1, 65_536, 2**32 - 1]):
        framed = records.frame(records.payload_of(-5, np.array(ids, "<u4")))
        payload, end = records.read_frame(memoryview(framed), 0, "here")
        key, back = records.sequence_of(payload)
        assert (key, back.tolist(), end) == (-5, ids, len(framed))
    assert records.sequence_of(memoryview(records.payload_of(None, np.array([3], "<u4"))))[0] is None


# 12


def plain_whitening(vectors, components=4):
    """Exact integers, plain loops."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    distinct = [list(v) for v in sorted({tuple(v) for v in x})]
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[i] for v in distinct) for i in range(d)]
    y = [[n * v[i] - s[i] for i in range(d)] for v in distinct]
    covariance = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    off = np.array([[float(Fraction(v[i] * n - s[i], n)) for i in range(d)] for v in x])
    return n, [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x], off @ u[:, :components] / np.sqrt(e[:components]), e[:components] / np.trace(covariance)


def test_whitening_equals_plain(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    found = queries.QUERIES["op12_embedding_whitening"](spark, DATA).toPandas().sort_values(["vec_id", "component"])
    n, deviations, white, explained = plain_whitening(rows["embedding"].tolist())
    assert (found["n"] == n).all() and found["deviation"].tolist() == [d for d in deviations for _ in range(4)]
    got = found["whitened"].to_numpy().reshape(-1, 4)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 4), explained, rtol=1e-9) and found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9


@pytest.mark.parametrize("size", [1.0, 1e6, 1e15, 3e16])
def test_scatter_is_exact_at_any_size(spark, size):
    random.seed(3)
    vectors = [[random.uniform(-size, size) for _ in range(5)] for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(vectors)) + [(0, vectors[0])] * 50, "vec_id long, embedding array<double>").repartition(7)
    model = whitening.fit(whitening.quantised(rows))
    x = sorted({tuple(int(np.floor(256 * c)) for c in v) for v in vectors})
    n, s = len(x), [sum(v[i] for v in x) for i in range(5)]
    assert (model.n, model.sums) == (n, s) and model.identity_error < 1e-9
    assert model.scatter.tolist() == [[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x) for j in range(5)] for i in range(5)]
    deviations = [sum((n * c - m) ** 2 for c, m in zip(v, s, strict=True)) for v in x]
    assert model.deviations(np.array(x, np.int64)) == [d if d < 1 << 63 else None for d in deviations]


def test_partial_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 3)
    rows = spark.createDataFrame([(k, [float(k % 7), float(k * k % 11), float(k)]) for k in range(60)], "vec_id long, embedding array<double>")
    x = whitening.quantised(rows).select("x").repartition(9)
    n, sums, most = whitening._totals(x)
    plain = np.array([r["x"] for r in x.collect()], object) * n - np.array(sums, object)
    assert (n, most) == (60, 59 * 256) and (whitening.scatter(x, n, sums, most) == plain.T @ plain).all()


def test_whitening_of_awkward_rows(spark, tmp_path):
    write_tables(tmp_path)
    found = queries.QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).toPandas()
    # the repeated vector counts once in the fit; 256e30 exceeds a long and becomes the largest
    assert set(found["n"]) == {5} and found["deviation"].isna().all()
    flat = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<double>")
    one = whitening.whiten(flat).toPandas()
    assert len(one) == 4 and one["whitened"].isna().all() and one["explained"].isna().all() and one["identity_error"].isna().all() and (one["deviation"] == 0).all()
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).toPandas()
    assert rows[rows["component"] == 2]["whitened"].isna().all() and rows["identity_error"].max() < 1e-9


# 13


def plain_runs(words, least=24, repeats=3):
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)  # the smallest period of equal stretches
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(k):
    out = []
    for _ in range(random.randint(0, 6)):
        part = [random.randrange(k) for _ in range(random.choice([1, 2, 3, 7, 8, 9, 13, 40]))]
        out += (part * random.randint(1, 12))[: random.randint(0, 200)]
        out += [random.randrange(k) for _ in range(random.randint(0, 20))] if random.random() < 0.5 else []
    return out


@pytest.mark.parametrize("at_once", [1 << 20, 10])
@pytest.mark.parametrize("least,repeats", [(24, 3), (10, 2), (4, 2), (25, 3), (26, 3), (30, 5)])
def test_runs_equal_plain(monkeypatch, at_once, least, repeats):
    random.seed(least)
    monkeypatch.setattr(periodic_runs, "AT_ONCE", at_once)
    for _ in range(25):
        texts = [repetitive(random.choice([1, 2, 3, 5, 50])) for _ in range(random.randint(1, 6))]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), offs, least, repeats)
        assert [[tuple(r) for r in rows.tolist()] for rows in found] == [plain_runs(t, least, repeats) for t in texts]


def contract_row(key, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op13_equals_the_contract(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert found == {k: contract_row(k, t) for k, t in zip(docs["doc_id"].tolist(), docs["text"], strict=True)}
    assert sum(r[0] > 0 for r in found.values()) > 10


def test_op13_of_awkward_rows(spark, tmp_path):
    write_tables(tmp_path)
    docs = awkward_pandas()["documents"]
    found = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    rows = [(int(k) if pd.notna(k) else None, t) for k, t in zip(docs["doc_id"], docs["text"], strict=True)]
    wanted = [(k, *contract_row(k, t)) for k, t in rows if t != LONG]
    long = [tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in found if r["n_words"] > 1000]
    assert sorted(map(str, (tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in found if r["n_words"] <= 1000))) == sorted(map(str, wanted))
    # the long text: one word 260,000 times and another at its end
    assert len(long) == 1 and long[0][1:6] == (1, 0, 260_000, 1, 260_000_000) and long[0][7] == hashlib.sha256(b"word end").hexdigest()


def test_find_runs_gives_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 10 + "y"), (2, "plain text"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}
    assert found[1]["collapsed"] == "x a b c y" and [tuple(r) for r in found[1]["runs"]] == [(1, 30, 3)] and tuple(found[1]["strongest"]) == (1, 30, 3)
    assert found[2]["runs"] == [] and found[2]["collapsed"] == "plain text" and found[3]["collapsed"] == "" and found[3]["strongest"] is None
