"""Each stage on what the one before kept, held against brute force on a small table."""

import corpus_pipeline
from causeway.llm import language_id, mixing, piece_sampling
from causeway.llm.piece_lattice import pieces
from tests.llm.test_operators import SCHEMA, _jaccard, _kept, _rows, brute_mixture, levels_of


def test_stages(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, "").cache()
        assert out.columns == docs.columns, name
        rows = out.collect()
        kept = {r["doc_id"]: r for r in rows}
        assert 0 < len(kept) == len(rows) <= len(given), name
        if name.startswith("language"):
            model = language_id.fit(docs)
            ids = sorted(given)
            _, _, rejected = model.predict([given[i]["text"] for i in ids])
            assert set(kept) == {i for i, r in zip(ids, rejected, strict=True) if not r}
        if name.startswith("near"):
            label = {i: i for i in given}
            pairs = [(i, j) for i in given for j in given if i < j and (given[i]["text"] == given[j]["text"] or _jaccard(given[i]["text"] or "", given[j]["text"] or "") >= 0.8)]
            for _ in given:
                for i, j in pairs:
                    label[i] = label[j] = min(label[i], label[j])
            assert set(kept) == {i for i in given if label[i] == i}
        if name.startswith("repeat"):
            want = _kept({i: r["text"] or "" for i, r in given.items()})
            assert {i: r["text"] for i, r in kept.items()} == {i: (want[i][2] if want[i][1] else given[i]["text"]) for i in given}
        if name.startswith("mixing"):
            plain = [(i, r["text"], levels_of((i, r["text"], r["lang"], r["source"]))) for i, r in given.items()]
            assert set(kept) == set(brute_mixture(plain, corpus_pipeline.MIX_SHARE, 1, 7, mixing.DOMAINS | mixing.LANGS))
        docs = out
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert "text" not in last.columns
    vocabulary = pieces(piece_sampling.model_path())
    assert {r["doc_id"]: piece_sampling.decode(vocabulary, r["piece_ids"]) for r in last.collect()} == given


def test_odd_rows_pass_all_stages(spark):
    """Nulls in every column, repeated rows, and columns with clashing names."""
    rows = [*_rows()[:30], _rows()[2], (None, _rows()[3][1], None, None, None, None, None), (None,) * 7, (5, None, "en", "src1", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("rank", "key").withColumnRenamed("id", "limit")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, "").cache()
        assert docs.count() > 0 and {"doc_id", "key", "limit"} <= set(docs.columns) and (name == "piece ids" or docs.columns == columns), name


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
