"""Phrases, line runs and manifests on small tables with nulls, ties, repeated rows and clashing names, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import itemset_phrases, line_runs, merkle
from causeway.llm.common import stored
from tests.llm.test_operators import SCHEMA, _rows

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINES = "all rights reserved. "


def _table():
    rows = [*_rows(), _rows()[2], _rows()[2]]
    out = [(None, "Null id.\nALL rights reserved.", None, None, None, None, None), (None,) * 7]
    for k, r in enumerate(rows):
        text = r[1] if r[1] is None or k % 4 else f"{r[1]}\n  {LINES.upper() if k % 8 else LINES}\x0b\n\nOne\ttwo, one  two; ONE two three four: é. One two"
        out.append((r[0], text, *r[2:]))
    return out


@pytest.fixture(scope="module")
def table(spark):
    """A small table whose columns have names that the operators use inside."""
    return spark.createDataFrame(_table(), SCHEMA).withColumnRenamed("rank", "h").withColumnRenamed("id", "d1").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11 ------------------------------------------------------------------------------------------


def _counts(rows, most=4):
    """By language: counts of phrases (tuples of words), and all words."""
    f, n = {}, Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def _best(rows, least, top):
    f, n = _counts(rows)
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in count.items() if b >= least):
                continue
            score, cut = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("shards", "bits", "chunk"), [(4, 1 << 16, 2 << 20), (1, 1 << 9, 300), (3, 1 << 20, 100)])
def test_phrases_by_counting(table, monkeypatch, shards, bits, chunk):
    """Also with a filter of so few bits that it admits nearly everything, and texts cut into many parts."""
    monkeypatch.setattr(itemset_phrases, "CHUNK_BYTES", chunk)
    rows = [r[:4] for r in _table()]
    f, n = _counts(rows)
    phrases = itemset_phrases.frequent_phrases(table, min_count=5, shards=shards, filter_bits=bits)
    got = {(r["lang"], r["phrase"]): r["n"] for r in phrases.collect() if r["k"]}
    assert got == {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 5}
    assert {r["lang"]: r["n"] for r in phrases.collect() if r["k"] == 0} == {k: v for k, v in n.items() if v}
    assert sorted(tuple(r) for r in itemset_phrases.collocations(phrases, top=40).collect()) == _best(rows, 5, 40)


def test_phrases_late_and_frequent(spark, none):
    """A phrase whose words reach the threshold in the last shard only is still counted over all shards."""
    texts = ["x y"] * 3 + ["z"] * 20 + ["x y w"] * 9
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    for shards in (2, 5):
        got = {r["phrase"]: r["n"] for r in itemset_phrases.frequent_phrases(docs, min_count=9, shards=shards, filter_bits=1 << 12).collect() if r["k"]}
        assert got == {"x": 12, "y": 12, "x y": 12, "w": 9, "y w": 9, "x y w": 9, "z": 20}
    assert itemset_phrases.frequent_phrases(none, filter_bits=1 << 12).count() == 0
    assert itemset_phrases.collocations(itemset_phrases.frequent_phrases(none, filter_bits=1 << 12)).count() == 0


def test_phrases_held_are_sent_in_parts(table, monkeypatch):
    whole = {tuple(r) for r in itemset_phrases.frequent_phrases(table, min_count=5, filter_bits=1 << 16).collect()}
    monkeypatch.setattr(itemset_phrases, "HELD", 50)
    monkeypatch.setattr(itemset_phrases, "CHUNK_BYTES", 200)
    assert {tuple(r) for r in itemset_phrases.frequent_phrases(table, min_count=5, filter_bits=1 << 16).collect()} == whole


def test_large_counts_are_exact(spark):
    n = 3 * 10**12
    rows = [("en", "", 0, 10**14), ("en", "a", 1, n + 1), ("en", "b", 1, n), ("en", "a b", 2, n - 1)]
    (got,) = itemset_phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, k int, n long")).collect()
    assert tuple(got) == ("en", 1, "a b", n - 1, n + 1, n, 10**14, 2_000_000 * (n - 1) // (2 * n + 1))


# ---- 12 ------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _leaf(r, text):
    return _h(*[_field(x) for x in (r[0], r[3], r[2], r[4], text)])


def _levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _path(levels, at, fanout):
    path = []
    for nodes in levels[:-1]:
        run = at - at % fanout
        path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
        at //= fanout
    return path


def _manifest(rows, fanout=8):
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), _leaf(r, r[1].translate(AZ) if hit else r[1]), r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [_levels([x[2] for x in sorted(groups[g])], fanout) for g in names]
    top = _levels([t[-1][0] for t in trees], fanout)
    out = []
    for k, g in enumerate(names):
        for at, (_, _, leaf, other, doc_id) in enumerate(sorted(groups[g])):
            path = _path(trees[k], at, fanout) + _path(top, k, fanout)
            folded = other
            for before, after in path:
                folded = _h(before, folded, after)
            out.append((str(doc_id), leaf, trees[k][-1][0], top[-1][0], _h(*[x for step in path for x in step]), folded, folded == top[-1][0]))
    return sorted(out)


def test_manifest(spark, table, none, tmp_path):
    table.select("doc_id", "source", "lang", "n_chars", "text", "h", "d1").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((str(r[0]), *r[1:]) for r in merkle.op12_merkle_manifest(spark, f"file://{tmp_path}").collect())
    assert got == _manifest(_table()) and {r[-1] for r in got} == {True, False}
    assert merkle.manifest(none, merkle.FIELDS, "lang", "doc_id").count() == 0


@pytest.mark.parametrize(("n", "langs", "fanout"), [(1, 1, 8), (2, 2, 8), (9, 1, 8), (70, 9, 8), (40, 3, 2)])
def test_manifests_of_all_shapes(spark, n, langs, fanout):
    rows = [(i, f"Text {i}", f"l{i % langs}", None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", fanout=fanout).withColumn("back", merkle.folded(F.col("leaf"), F.col("path")))
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["back"]) for r in told.collect())
    assert got == [(w[0], w[1], w[2], w[3], w[3]) for w in _manifest(rows, fanout)]


def test_places_in_groups(spark):
    """Most rows in one group, and repeated rows."""
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "a").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") % 700).alias("x"), F.col("id").alias("tie"))
    got = merkle.numbered(stored(rows), "g", ["x", "tie"]).toPandas().sort_values(["g", "x", "tie"])
    assert (got["at"] == got.groupby("g").cumcount()).all() and (got["n"] == got.groupby("g")["x"].transform("size")).all()


# ---- 13 ------------------------------------------------------------------------------------------


def _without(rows, least_docs, least_chars):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    lines = [(r[1] or "").split("\n") for r in rows]
    docs = Counter(k for ls in lines for k in {key(x) for x in ls})
    common = {k for k, n in docs.items() if n >= least_docs and len(k) >= least_chars}
    out = []
    for r, ls in zip(rows, lines, strict=True):
        kept = [x for x in ls if key(x) not in common]
        out.append((str(r[0]), len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "least_chars", "batches", "fanout"), [(10, 1, 8, 4), (2, 1, 5, 2), (2, 4, 1, 4), (1, 1, 3, 3)])
def test_lines_by_counting(table, none, least_docs, least_chars, batches, fanout):
    out = line_runs.without_common_lines(table, min_docs=least_docs, min_chars=least_chars, batches=batches, fanout=fanout)
    assert out.columns == [*table.columns, "n_lines", "n_dropped", "kept_text"]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect())
    assert got == _without(_table(), least_docs, least_chars) and any(r[2] for r in got)
    assert line_runs.without_common_lines(none).count() == 0


def test_runs_are_levelled(spark, tmp_path):
    """Ten batches leave runs of 4, 4, 1 and 1 batches; a folder goes on where it was; broken runs don't count."""
    rng = np.random.default_rng(5)
    store = line_runs.LineRuns(spark, f"file://{tmp_path}/runs", min_docs=6, fanout=4, buckets=3)
    total = Counter()
    for k in range(10):
        keys = [int(x) for x in rng.integers(0, 40, 20)] + [99] * 3
        total.update(keys)
        if k == 5:
            (tmp_path / "runs" / "run-5-5-3").mkdir()  # a write that broke off
            store = line_runs.LineRuns(spark, f"file://{tmp_path}/runs", min_docs=6, fanout=4)
            assert store.buckets == 3
        store.add(spark.createDataFrame([(x, x + 1) for x in keys], "h1 long, h2 long"))
    assert store.runs() == [(0, 3), (4, 7), (8, 8), (9, 9)]
    assert {r["h1"] for r in store.frequent().collect()} == {x for x, n in total.items() if n >= 6}
    asked = spark.createDataFrame([(x, x + 1) for x in range(120)], "h1 long, h2 long")
    assert {r["h1"] for r in store.unseen(asked).collect()} == set(range(120)) - set(total)
    plan = store._without(asked, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 4 and plan.count("Bucketed: true") == 4 or "BroadcastHashJoin" in plan


def test_a_line_of_most_documents(spark):
    """A line in each of 6,000 documents is looked up apart from the others."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Home\n"), F.col("id").cast("string"), F.lit("\n home ")).alias("text"))
    rows = line_runs.without_common_lines(docs, batches=2).groupBy("n_lines", "n_dropped", (F.col("kept_text") == F.col("doc_id").cast("string")).alias("same")).count().collect()
    assert [tuple(r) for r in rows] == [(3, 2, True, 6000)]
