"""Document likelihood by subword lattices.

The pieces are those of an existing vocabulary; its scores start the weights. A word is the string
of U+2581 and itself, and its likelihood sums over all its segmentations: a forward recursion in log
space. Training documents fall into at most CLASSES + 1 classes (a label such as the language; the
rest share one). Per class, piece weights are re-estimated by expectation maximisation over the
distinct training words, and a word seen in training is also a piece by itself: its count less
DISCOUNT, over all tokens, plus the discounted mass times the lattice's likelihood. A document is
its words and one end; its probability is the sum over classes of the class's share times the
product over its tokens. Beside it stands the lattice alone: the vocabulary's own scores as weights,
no training but the share of ends among tokens.

Word counts cover all training documents and stay a distributed table. The HOT words seen most
often are broadcast (a fixed number, each of bounded length); occurrences of all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from causeway.llm.common import documents, fresh, stored
from causeway.llm.piece_lattice import SPACE_MARK, Pieces, as_bytes, pieces
from causeway.llm.piece_sampling import ALPHA, model_path

CLASSES = 6
ROUNDS = 2
DISCOUNT = 0.75
PSEUDO_COUNT = 0.01
HOT = 65_536
HOT_BYTES = 64
#: Bytes of words whose lattices a task holds at once (a longer word is alone), and distinct words it counts before it passes counts on.
BATCH_BYTES, HELD = 200_000, 200_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() and bytes.lower() know ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _as_strings(words: list[bytes]) -> list[str]:
    return [SPACE_MARK + w.decode() for w in words]


def _batches(words: pd.Series) -> Iterator[slice]:
    """Stretches of words of about BATCH_BYTES bytes."""
    upto = words.str.len().to_numpy().cumsum()
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield slice(at, end)
        at = end


def _count(docs: DataFrame, k: int) -> DataFrame:
    """(word, n, c0 .. ck-1): occurrences in all of docs and in each class of the training documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [Counter() for _ in range(k + 1)]

        def out() -> pd.DataFrame:
            rows = [(w, c, n) for c, counter in enumerate(held) for w, n in counter.items()]
            for counter in held:
                counter.clear()
            return pd.DataFrame(rows, columns=["word", "c", "n"])

        for b in batches:
            for text, c in zip(b["text"], b["c"], strict=True):
                held[c].update(tokens(text))
                if sum(map(len, held)) > HELD:
                    yield out()
        yield out()

    counted = docs.select("text", F.coalesce("c", F.lit(k)).alias("c")).mapInPandas(count, "word binary, c int, n long")
    by_class = [F.sum(F.when(F.col("c") == j, F.col("n")).otherwise(0)).alias(f"c{j}") for j in range(k)]
    return counted.groupBy("word").agg(F.sum("n").alias("n"), *by_class)


def _estimate(words: DataFrame, k: int, path: str, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the distinct words of each class, as new log weights."""
    shared = words.sparkSession.sparkContext.broadcast(logp)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, total = pieces(path), np.zeros_like(logp)
        for b in batches:
            for cut in _batches(b["word"]):
                part = b.iloc[cut]
                for j in range(k):
                    mine = part["word"][part[f"c{j}"] > 0].tolist()
                    if not mine:
                        continue
                    lattice = vocabulary.lattice(_as_strings(mine))
                    w = vocabulary.edge_weights(lattice.piece, shared.value[j])
                    used = lattice.expected(w, lattice.forward(w), np.ones(lattice.n))
                    plain = lattice.piece >= 0
                    total[j] += np.bincount(lattice.piece[plain], used[plain], minlength=vocabulary.size)
                    for p, n in zip(lattice.piece[~plain].tolist(), used[~plain].tolist(), strict=True):
                        np.add.at(total[j], vocabulary.byte_id[list(as_bytes(-1 - p))], n)
        c, p = np.nonzero(total)
        yield pd.DataFrame({"c": c, "p": p, "n": total[c, p]})

    cols = [f"c{j}" for j in range(k)]
    sums = words.where(" or ".join(f"{c} > 0" for c in cols)).select("word", *cols)
    rows = sums.mapInPandas(expect, "c int, p int, n double").groupBy("c", "p").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros_like(logp)
    found[rows["c"], rows["p"]] = rows["n"]
    found[np.isfinite(logp)] += PSEUDO_COUNT
    with np.errstate(divide="ignore"):
        return np.log(found / found.sum(axis=1, keepdims=True))


def lexicon_and_lattice(vocabulary: Pieces, logp: np.ndarray, words: list[bytes], counts: np.ndarray, n: np.ndarray, types: np.ndarray) -> np.ndarray:
    """log10 probability of each word (row) in each class (column); counts are its counts there. The last column is the lattice alone."""
    lattice, out = vocabulary.lattice(_as_strings(words)), np.empty((len(words), len(logp) + 1))
    for j in range(len(logp)):
        alpha = lattice.forward(vocabulary.edge_weights(lattice.piece, logp[j]))
        ways = np.empty(lattice.n)
        ways[lattice.order] = alpha[lattice.final]
        if n[j]:
            ways += np.log(DISCOUNT * types[j] / n[j])
            with np.errstate(divide="ignore"):
                ways = np.logaddexp(ways, np.log(np.maximum(counts[:, j] - DISCOUNT, 0) / n[j]))
        out[:, j] = ways / np.log(10)
    alone = lattice.forward(vocabulary.edge_weights(lattice.piece, vocabulary.unigram(ALPHA)))
    out[lattice.order, -1] = alone[lattice.final] / np.log(10)
    return out


def score(docs: DataFrame, train: Column, label: str | None = None, text: str = "text", model: str | None = None) -> DataFrame:
    """The columns of docs but the text, with n_tokens, n_known, train_tokens, base_score, score and lattice_score in place of any so named.

    train tells the training documents. A null text is empty: one token, its end. Texts of any length
    are read whole; repeated rows each count and each get their score. A null label goes to the class
    of rare labels. Without training documents the vocabulary's own scores serve, and an empty table
    stays empty. Other columns stay, whatever their names.
    """
    spark, path = docs.sparkSession, model or model_path()
    vocabulary = pieces(path)
    kept = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
    row, trains = fresh(kept, "row", "trains")
    keyed = kept.withColumn(row, F.monotonically_increasing_id()).withColumn(trains, F.coalesce(train, F.lit(False)))
    name = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    frequent = [r["l"] for r in keyed.where(trains).groupBy(name.alias("l")).count().orderBy(F.desc("count"), "l").limit(CLASSES).collect()]
    k = len(frequent) + 1
    c = F.lit(len(frequent))
    for j, l in enumerate(frequent):
        c = F.when(name == l, j).otherwise(c)
    n_docs = np.zeros(k, np.int64)
    for r in keyed.where(trains).groupBy(c.alias("c")).count().collect():
        n_docs[r["c"]] = r["count"]

    words = stored(_count(keyed.select(F.col(text).alias("text"), F.when(F.col(trains), c).alias("c")), k))
    cs = [f"c{j}" for j in range(k)]
    seen = F.expr(" + ".join(cs))
    sums = words.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in cs], *[F.count_if(F.col(x) > 0) for x in cs], F.count_if(seen > 0)).first()
    n = np.array(sums[:k]) + n_docs
    types = np.array(sums[k : 2 * k]) + (n_docs > 0)
    n_train, n_types = int(n.sum()), sums[2 * k] + int(n_docs.sum() > 0)

    logp = np.tile(vocabulary.unigram(ALPHA), (k, 1))
    if n_train:
        for _ in range(ROUNDS):
            logp = _estimate(words, k, path, logp)
    shared = spark.sparkContext.broadcast(logp)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cut in _batches(b["word"]):
                part = b.iloc[cut]
                counts = part[cs].to_numpy()
                got = lexicon_and_lattice(pieces(path), shared.value, part["word"].tolist(), counts, n, types)
                c_all = counts.sum(axis=1)
                yield pd.DataFrame({"word": part["word"].to_numpy(), "n": part["n"].to_numpy(), "known": c_all > 0, "b": np.log10(c_all + 0.5)} | {f"s{j}": got[:, j] for j in range(k + 1)})

    ss = [f"s{j}" for j in range(k + 1)]
    rated = stored(words.mapInPandas(rate, "word binary, n long, known boolean, b double, " + ", ".join(f"{s} double" for s in ss)))
    # the counts from which at most HOT words are left, by sixteenths of a power of two; no task sends more than its share of them
    short, step = rated.where(F.length("word") <= HOT_BYTES), F.floor(F.log2("n") * 16)
    kept_steps, left = [], HOT
    for r in short.groupBy(step.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect():
        left -= r["n"]
        if left < 0:
            break
        kept_steps.append(r["k"])
    top = short.where(step >= min(kept_steps, default=1 << 20)).select("word", "known", "b", *ss).toPandas()
    hot = spark.sparkContext.broadcast(({w: i for i, w in enumerate(top["word"])}, top[["known", "b", *ss]].to_numpy(float).reshape(-1, k + 3)))

    others = [x for x in kept.columns if x != text]
    given = keyed.select(F.col(row).alias("_row"), *[F.col(f"`{x}`").alias(f"_u{i}") for i, x in enumerate(others)], F.col(text).alias("text"))
    found_type = "n long, known long, b double, " + ", ".join(f"{s} double" for s in ss) + ", rare array<binary>, times array<int>"
    result = T.StructType(given.schema.fields[:-1] + T.StructType.fromDDL(found_type).fields)
    parts = to_arrow_schema(result)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = hot.value
        find = index.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sums, sizes, rare, times, ends = np.zeros((b.num_rows, k + 3)), [], [], [], [0]
                for i, t in enumerate(b.column("text").to_pylist()):
                    found = Counter(tokens(t))
                    at_hot = np.fromiter((find(w, -1) for w in found), np.int64, len(found))
                    often = np.fromiter(found.values(), np.int64, len(found))
                    is_hot = at_hot >= 0
                    sums[i] = often[is_hot] @ table[at_hot[is_hot]]
                    sizes.append(int(often.sum()) + 1)
                    if not is_hot.all():
                        listed = list(found)
                        cold = np.flatnonzero(~is_hot)
                        rare += [listed[x] for x in cold]
                        times.append(often[cold])
                    ends.append(len(rare))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *b.columns[:-1], pa.array(sizes, pa.int64()), pa.array(sums[:, 0].astype(np.int64)),
                    *[pa.array(sums[:, j]) for j in range(1, k + 3)],
                    pa.ListArray.from_arrays(offsets, pa.array(rare, pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times) if times else [], pa.int32())),
                ], schema=parts)

    walked = stored(given.mapInArrow(walk, result))
    cold = walked.where(F.size("rare") > 0).select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("word"), F.col("x.times").alias("t"))
    cold = cold.join(rated.drop("n"), "word").select("_row", F.lit(0).cast("long").alias("n"), (F.col("known").cast("long") * F.col("t")).alias("known"), *[(F.col(x) * F.col("t")).alias(x) for x in ("b", *ss)])
    sums = walked.select("_row", "n", "known", "b", *ss).unionByName(cold).groupBy("_row").agg(*[F.sum(x).alias(x) for x in ("n", "known", "b", *ss)])

    end_known = int(n_docs.sum() > 0)
    norm = float(np.log10(n_train + 0.5 * (n_types + 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.log10(np.maximum(n_docs - DISCOUNT, 0) / n) + np.log10(n_docs / n_docs.sum()) if n_train else np.log10(np.full(k, 0.1 / k))
    usable = [j for j in range(k) if np.isfinite(own[j])]
    each = [F.col(ss[j]) + F.lit(float(own[j])) for j in usable]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    total = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in each), F.lit(0.0)))
    # without training one token in ten is taken to be an end
    end = float(n_docs.sum() / n_train) if n_train else 0.1
    words_only = F.col("n") - 1
    alone = F.col(ss[k]) + (words_only * F.lit(float(np.log10(1 - end))) if end < 1 else F.lit(0.0)) + F.lit(float(np.log10(end)))
    scored = sums.select(
        "_row", F.col("n").alias("n_tokens"), (F.col("known") + end_known).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("b") + F.lit(float(np.log10(n_docs.sum() + 0.5))) - F.col("n") * F.lit(norm)).alias("base_score"), total.alias("score"), alone.alias("lattice_score"),
    )
    own_columns = walked.select("_row", F.struct(F.lit(0).alias("_"), *[F.col(f"_u{i}") for i in range(len(others))]).alias("own"))
    figures = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"]
    return own_columns.join(scored, "_row").select(*[F.col(f"own._u{i}").alias(x) for i, x in enumerate(others)], *figures)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score of all documents, the held-out fifth taught nothing; see score() for nulls, empty texts, repeated rows and empty tables."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score(docs.withColumn("held_out", held), ~held, label="lang").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
