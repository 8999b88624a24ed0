"""Tables with nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""

import pandas as pd

#: Above the size at which texts are cut into slices.
LONG = "word " * 260_000 + "end"


def awkward_pandas(empty: bool = False) -> dict[str, pd.DataFrame]:
    texts = [None, "", " \n\t ", "one", "Same text here now", "same TEXT here now", "same text here now", LONG, "x" * 3000, "É same é", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p q", None, "idiot and moron, MIT License", "\x00 odd \u2028 bytes 😀"]
    n = len(texts)
    documents = pd.DataFrame(
        {
            "doc_id": pd.array([*range(n - 1), None], "Int64"),
            "text": texts,
            "lang": [None, "en"] * (n // 2) + [None],
            "source": ["s1", None, "s2", "s1", "", "s2", "s1", "s3", "s1", None, "s2", "s1", "s4", "s1", None],
            "n_chars": pd.array([None] * n, "Int64"),
            **{name: [f"clash {name}"] * n for name in ("id", "size", "target", "digest", "norm", "kept", "row", "part", "guard", "weight", "score", "component", "piece", "start", "s", "rep", "word", "copies", "html", "host")},
        }
    )
    documents = pd.concat([documents, documents.iloc[[3, 6]]], ignore_index=True)  # repeated rows
    labels = pd.DataFrame({"doc_id": pd.array([13, 3, 4, None, 13], "Int64"), "quality": pd.array([1, 0, None, 1, 1], "Int64"), "toxic": pd.array([1, 0, None, 1, 1], "Int64")})
    pages = pd.DataFrame(
        {
            "page_id": pd.array([0, 1, 2, 3, 4, 5, None, 0], "Int64"),
            "url": [None, "no scheme", "http://A.Example.org/es/x?y#z", "https://example.org", "x://u@h.com:80/de/1#?", "http://b.example.org/en/12", "://", None],
            "html": [None, "", "<article><p>a &amp; b<p>c</article><footer>f", "plain", "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>" + "long " * 250_000, "<script>x", None],
            "host": ["clash"] * 8,
            "text": ["clash"] * 8,
            "wrapper": ["clash"] * 8,
        }
    )
    vectors = [[1.5, -0.25, 3.0], None, [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [], [1.0, 2.0], [1.5, -0.25, 3.0], [-0.001, 0.0, -0.0], [0.0, 7.0, 1e30], [4.0, 4.0, 4.0], [0.5, -2.0, 1.0]]
    embeddings = pd.DataFrame({"vec_id": pd.array([*range(11), None], "Int64"), "embedding": vectors, **{name: ["clash"] * 12 for name in ("x", "n", "component", "__key", "whitened")}})
    embeddings = pd.concat([embeddings, embeddings.iloc[[8]]], ignore_index=True)
    frames = {"documents": documents, "labels": labels, "pages": pages, "embeddings": embeddings}
    return {k: v.iloc[:0] if empty else v for k, v in frames.items()}


def write_tables(folder, empty: bool = False) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, frame in awkward_pandas(empty).items():
        table = pa.Table.from_pandas(frame, preserve_index=False)
        kinds = dict.fromkeys(("doc_id", "page_id", "vec_id", "n_chars", "quality", "toxic"), pa.int64()) | {"embedding": pa.list_(pa.float32())}
        fields = [pa.field(f.name, kinds.get(f.name, pa.string())) for f in table.schema]
        pq.write_table(table.cast(pa.schema(fields)), folder / f"{name}.parquet")
