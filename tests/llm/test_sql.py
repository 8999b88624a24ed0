"""Operators that SQL can express against their SQL, on a driver table and on awkward rows."""

from pathlib import Path

import pytest
from awkward import awkward_pandas, write_tables
from helpers import DATA, duck, same

from quillgraph.llm import common, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_driver_tables(spark, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), duck(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_awkward_tables(spark, tmp_path, name):
    write_tables(tmp_path)
    same(queries.QUERIES[name](spark, str(tmp_path)).toPandas(), duck(queries.SQL[name], **awkward_pandas()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    write_tables(tmp_path, empty=True)
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_row_has_a_result(spark, tmp_path, name):
    write_tables(tmp_path)
    found = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    frames = awkward_pandas()
    rows = frames["pages" if name.startswith(("op5", "op6")) else "documents"]
    if name == "op2_fingerprints":
        assert len(found) == rows["doc_id"].notna().sum()
    elif name == "op7_best_fit_packing":
        assert (found["piece"] == 0).sum() == len(rows)
    elif name == "op12_embedding_whitening":
        # seven sound vectors of the usual length, one of them twice, and three components
        assert len(found) == 7 * 3 and found["vec_id"].nunique() == 5
    else:
        assert len(found) == len(rows)


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_awkward_tables(spark, tmp_path, empty):
    import corpus_pipeline

    write_tables(tmp_path, empty)
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, str(tmp_path)))
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts == sorted(counts[:4], reverse=True) + counts[4:] and (counts[-1] == 0) == empty
    if not empty:
        # two of three equal texts and the repeated row go; what has no key stays
        assert counts[1] - counts[2] == 5 + 1


def test_scratch_tables_go(spark, tmp_path):
    with common.scratch(spark):
        inner = common.saved(spark.range(3))
        outer = common.saved(spark.range(4), outlives=True)
        path = inner.inputFiles()[0]
    assert outer.count() == 4 and not Path(path.removeprefix("file://").removeprefix("file:")).exists()
