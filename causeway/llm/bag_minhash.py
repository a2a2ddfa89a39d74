"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word-shingle bags, bands, exact check.

A bag holds each five-word shingle with its number of occurrences (a text of one to four words is
one shingle). Each shingle owns a Poisson process over time and weight, cut into the octaves [0,1),
[1,2), [2,4), [4,8) .. of weight, each a process of its own, so a shingle of weight w has log2(w)
processes to look at; points beyond w are skipped. Every point falls on one of the signature's
slots, and a slot keeps the earliest. Two bags agree in a slot with probability equal to their
weighted Jaccard likeness. Only points before the time at which a bag's slots are full are made.

Equal texts are one node, known by their smallest id. Nodes that share a band's slots meet in a bucket; a bucket first compares its
members with those of its lowest and highest label. Bags of candidate pairs are compared exactly.
Components then become the labels; in a bucket that still holds several, two members of each (the
smallest id, and one by hash) are compared in the same way, until no new link is found. What is left,
members of one bucket in different components, is then compared whole, by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import HOT_PART, documents, fresh, hot_keys, looked_up, stored, with_long_ids
from causeway.llm.components import components, relabelled
from causeway.llm.word_hashes import mix, run_hashes, word_hashes

SHINGLE = 5
LIKENESS = 0.8
#: A pair at the bound is missed by all bands with probability (1 - 0.8^4)^24, 3 in a million.
BANDS, ROWS = 24, 4
#: Bytes of text handled at once by a task.
CHUNK_BYTES = 1 << 20
#: Texts and bytes of text in a block of a bucket that is compared whole.
BLOCK_MEMBERS, BLOCK_BYTES = 1 << 10, 2 << 20
#: Tokens of so few texts are paired one by one, others by products of matrices with so many columns.
RARE, COLUMNS = 16, 4096
#: Copies of a text that a large part of all pairs needs.
SALTS = 32
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def bags(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, occurrences) of all bags, ordered by text."""
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    full = run_hashes(words, size)
    inside = np.arange(len(full)) + size <= ends[owner[: len(full)]]
    text, shingle = owner[: len(full)][inside], full[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([run_hashes(words[ends[k] - counts[k] : ends[k]], counts[k])[0] for k in short], np.uint64)
        text, shingle = np.concatenate([text, short]), np.concatenate([shingle, whole])
    by = np.lexsort((shingle, text))
    text, shingle = text[by], shingle[by]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])]))
    return text[new], shingle[new], np.diff(np.append(new, len(text)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """n x slots: the earliest point of each slot; 0 in rows of empty bags."""
    total = np.bincount(text, weight, minlength=n)
    best, point = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    octaves = np.ceil(np.log2(weight)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(text)), octaves)
    octave = np.arange(len(which)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    rate = np.where(octave == 0, 1.0, 2.0 ** np.maximum(octave - 1, 0))
    start = np.where(octave == 0, 0.0, rate)
    owner, bound = text[which], weight[which].astype(float)
    key = mix(shingle[which] + octave.astype(np.uint64) * _A)
    open_rows, factor = total > 0, 4.0
    while open_rows.any():
        until = slots * (np.log(slots) + factor) / np.where(total > 0, total, 1)
        live = np.flatnonzero(open_rows[owner])
        time, step = np.zeros(len(live)), 0
        while len(live):
            step += 1
            k = key[live] + np.uint64(step * int(_B) % 2**64)
            time = time - np.log(_uniform(k)) / rate[live]
            early = np.flatnonzero(time <= until[owner[live]])
            live, time, k = live[early], time[early], k[early]
            hit = np.flatnonzero(start[live] + _uniform(k ^ _C) * rate[live] <= bound[live])
            at = owner[live[hit]] * slots + (mix(k[hit] ^ _D) % np.uint64(slots)).astype(np.int64)
            np.minimum.at(best, at, time[hit])
            first = best[at] == time[hit]
            point[at[first]] = mix(k[hit][first])
        open_rows &= np.isinf(best.reshape(n, slots)).any(axis=1)
        factor *= 2
    return point.reshape(n, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None] * _A
    for r in range(ROWS):
        key = mix(key + grouped[:, :, r]) * _B
    return key.view(np.int64)


def likeness(a: bytes, b: bytes) -> float:
    """Weighted Jaccard likeness of two texts' bags; 0 if one is empty."""
    text, shingle, n = bags([a, b])
    cut = int(np.searchsorted(text, 1))
    both, i, j = np.intersect1d(shingle[:cut], shingle[cut:], assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[:cut][i], n[cut:][j]).sum())
    return shared / (int(n.sum()) - shared) if len(both) else 0.0


def _raw(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "replace")


def sign(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, bands) of docs (id, text): a 128-bit hash of the text, and its bands' keys (none for an empty bag)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, at, held = b["text"].str.len().fillna(0).to_numpy(), 0, 0
            for k, n in enumerate(sizes):
                held += n
                if held >= CHUNK_BYTES or k == len(sizes) - 1:
                    some = [_raw(t) for t in b["text"].iloc[at : k + 1]]
                    bag = bags(some)
                    keys, full = band_keys(signatures(len(some), *bag)), np.bincount(bag[0], minlength=len(some)) > 0
                    two = np.array([(d >> 64, d & (2**64 - 1)) for d in map(xxhash.xxh3_128_intdigest, some)], np.uint64).view(np.int64)
                    ids = b["id"].iloc[at : k + 1].to_numpy()
                    yield pd.DataFrame({"id": ids, "k1": two[:, 0], "k2": two[:, 1], "bands": [x if f else x[:0] for x, f in zip(keys, full, strict=True)]})
                    at, held = k + 1, 0

    return docs.mapInPandas(work, "id long, k1 long, k2 long, bands array<long>")


def _candidates(members: DataFrame) -> DataFrame:
    """(lo, hi) of members (key, id, label): each with those of its bucket's lowest and highest label, where labels differ."""
    me = F.struct("label", "id")
    chosen = stored(members.groupBy("key").agg(F.min(me).alias("a"), F.max(me).alias("b"), F.count("*").alias("n")).where("a.label != b.label"))
    total = chosen.agg(F.sum("n")).first()[0] or 0
    # fewer than the inverse of HOT_PART
    hot = stored(chosen.where(F.col("n") > total * HOT_PART).select("key"))
    met = looked_up(members, chosen.drop("n"), ["key"], hot=hot).select("id", "label", F.explode(F.array("a", "b")).alias("r")).where("label != r.label")
    return met.select(F.least("id", "r.id").alias("lo"), F.greatest("id", "r.id").alias("hi")).distinct()


def _stand_ins(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label): for each bucket and component in it two of the component's members, the smallest id and one by hash."""
    labelled = nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), F.explode("bands").alias("key"))
    two = labelled.groupBy("key", "label").agg(F.min("id").alias("a"), F.min_by("id", F.xxhash64("id", "key")).alias("b"))
    return two.select("key", "label", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (lo, hi) of which the texts (id, text) are alike enough.

    A text that many pairs need is copied SALTS times, so that no task gets all of its pairs.
    """
    ends = [hot_keys(pairs, [c]) for c in ("lo", "hi")]
    ends = [h.toDF("id") for h in ends if h is not None]
    hot = ends[0].union(ends[-1]).distinct() if ends else None
    if hot is None:
        lows = pairs.join(texts.select(F.col("id").alias("lo"), F.col("text").alias("lo_text")), "lo")
        rows = lows.join(texts.select(F.col("id").alias("hi"), F.col("text").alias("hi_text")), "hi")
    else:
        # both joins read the same copies, dealt once
        copied = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        marked = texts.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "id", "left").select("id", "text", copied.alias("salt"))

        def with_text(rows: DataFrame, side: str, other: str) -> DataFrame:
            salt = F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int")
            salted = rows.join(F.broadcast(hot.select(F.col("id").alias(side), F.lit(True).alias("hot"))), side, "left").withColumn("salt", salt).drop("hot")
            return salted.join(marked.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"), "salt"), [side, "salt"]).drop("salt")

        rows = with_text(with_text(pairs, "lo", "hi"), "hi", "lo")

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(_raw(x), _raw(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return rows.select("lo", "hi", like("lo_text", "hi_text").alias("s")).where(F.col("s") >= LIKENESS).select("lo", "hi")


def _linked(raws: list[bytes], left: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of differently labelled texts that are alike enough, of the first so many with all others (0: of all)."""
    n, (text, shingle, times) = len(raws), bags(raws)
    total = np.bincount(text, times, minlength=n)
    # the k-th occurrence of a shingle is a token, so that bags share as many tokens as weight
    which = np.repeat(np.arange(len(text)), times)
    k = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    tokens, column, often = np.unique(mix(shingle[which] + k.astype(np.uint64) * _A), return_inverse=True, return_counts=True)
    by = np.lexsort((text[which], column))
    column, owner = column[by], text[which][by]
    shared, rare = np.zeros((n, n)), often[column] <= RARE
    c, o = column[rare], owner[rare]
    for d in range(1, min(RARE, len(c))):
        same = c[d:] == c[:-d]
        shared += np.bincount(o[:-d][same] * n + o[d:][same], minlength=n * n).reshape(n, n)
    c, o = np.unique(column[~rare], return_inverse=True)[1], owner[~rare]
    a, b = (slice(left), slice(left, n)) if left else (slice(n), slice(n))
    for at in range(0, int(c[-1]) + 1 if len(c) else 0, COLUMNS):
        s = slice(*np.searchsorted(c, [at, at + COLUMNS]))
        has = np.zeros((n, COLUMNS), np.float32)
        has[o[s], c[s] - at] = 1
        shared[a, b] += has[a] @ has[b].T
    i, j = np.nonzero(np.triu(shared, 1))
    met = (labels[i] != labels[j]) & ((i < left) & (j >= left) if left else True)
    i, j = i[met], j[met]
    like = shared[i, j] / (total[i] + total[j] - shared[i, j]) >= LIKENESS
    return i[like], j[like]


def _rest(members: DataFrame, labels: DataFrame | None, texts: DataFrame) -> DataFrame:
    """(lo, hi): links between labels by all likenesses of differently labelled members (key, id) of one bucket.

    Only buckets of over three members with several labels have pairs that were not compared so far; of
    buckets with the same members one is looked at. Its members are dealt into blocks and blocks are
    compared by pairs, those of the commonest label with the others' only. A task gives one link for
    each label that it joins to another, not all pairs.
    """
    held = members.select("key", "id").join(texts.select("id", F.octet_length("text").alias("size")), "id")
    held = held.withColumn("label", F.col("id")) if labels is None else held.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    held = stored(held)
    codes = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    per = held.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *codes)
    bucket = per.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("labels"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("top"), *[F.bit_xor(f"h{k}").alias(f"h{k}") for k in (0, 1)]
    ).where("n > 3 and labels > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_MEMBERS, size / BLOCK_BYTES, F.lit(1.0))).cast("int")
    bucket = bucket.groupBy("n", "h0", "h1").agg(F.min_by(F.struct("key", "top", "size"), "key").alias("r")).select(
        "r.key", F.col("r.top.label").alias("most"), blocks(F.col("r.top.n"), F.col("r.top.size")).alias("c0"),
        blocks(F.col("n") - F.col("r.top.n"), F.col("r.size") - F.col("r.top.size")).alias("c1"),
    )
    met, common = held.join(bucket, "key"), F.col("label") == F.col("most")
    block = F.when(common, F.pmod(F.xxhash64("id"), F.col("c0"))).otherwise(F.col("c0") + F.pmod(F.xxhash64("id"), F.col("c1"))).cast("int")
    to = F.explode(F.sequence(F.when(common, F.col("c0")).otherwise(0), F.col("c0") + F.col("c1") - 1)).alias("to")
    pairs = met.select("key", "id", "label", block.alias("own"), to).select("key", "id", "label", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), (F.col("own") > F.col("to")).alias("second"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("second", kind="stable")
        cross, left = rows["i"].iloc[0] != rows["j"].iloc[0], int((~rows["second"]).sum())
        names, label = np.unique(rows["label"].to_numpy(np.int64), return_inverse=True)
        if len(names) < 2 or cross and left in (0, len(rows)):
            return pd.DataFrame({"lo": [], "hi": []}, dtype=np.int64)
        i, j = _linked([_raw(t) for t in rows["text"]], left if cross else 0, label)
        a, b, root = label[i], label[j], np.arange(len(names))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
        joined = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"lo": names[root[joined]], "hi": names[joined]})

    return pairs.join(texts, "id").groupBy("key", "i", "j").applyInPandas(work, "lo long, hi long").distinct()


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels (id, label) after the links found (lo, hi)."""
    if labels is None:
        return components(found)
    of = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))
    ends = looked_up(stored(looked_up(found, of("lo", "a"), ["lo"], "left")), of("hi", "b"), ["hi"], "left")
    roots = components(ends.select(F.coalesce("a", "lo").alias("lo"), F.coalesce("b", "hi").alias("hi")))
    # ids without a label so far are their own
    fresh = roots.join(labels, "id", "left_anti").where("id != label")
    return stored(relabelled(labels, roots).unionByName(fresh))


def near_classes(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, text_id, class_id): one row a document.

    text_id is the smallest id among documents with the same text, class_id the smallest among those
    linked to it by a chain of likenesses of 0.8 or more. A null text is empty. Texts without words
    are like none but equal ones. Rows that share an id are one document as far as classes go; if
    their texts differ, the one with the smallest hash is compared exactly. A row with a null id gets
    a negative id of its own in its place. Other columns of docs are left out. An empty table gives
    an empty result.
    """
    given = with_long_ids(docs.select(F.col(row_id).alias("given"), F.coalesce(text, F.lit("")).alias("text")), "given", "id").select("id", "text")
    signed = stored(sign(given))
    nodes = stored(signed.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("bands").alias("bands")))
    banded = nodes.select(F.col("node").alias("id"), "bands")
    members = stored(banded.select("id", F.explode("bands").alias("key")).withColumn("label", F.col("id")))
    # buckets with one node only are done
    shared = members.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x != y").select("key")
    members = buckets = stored(members.join(shared, "key"))
    texts = stored(given.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    tested = labels = None
    while True:
        pairs = _candidates(members)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["lo", "hi"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        found = stored(_verified(pairs, texts))
        if found.isEmpty():
            break
        labels = _merged(labels, found)
        members = stored(_stand_ins(banded, labels))
    found = stored(_rest(buckets, labels, texts))
    if not found.isEmpty():
        labels = _merged(labels, found)
    labels = labels if labels is not None else found.toDF("id", "label")
    labels = labels.withColumnRenamed("id", "node")
    by_text = stored(nodes.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.col("node").alias("text_id"), F.coalesce("label", "node").alias("class_id")))
    # copies of one text may be a third of all rows
    return looked_up(signed.select("id", "k1", "k2"), by_text, ["k1", "k2"]).select(F.col("id").alias(row_id), "text_id", "class_id")


def one_per_class(docs: DataFrame) -> DataFrame:
    """docs without those that have a near duplicate of a smaller id.

    Of rows that share an id the one with the smallest hash stays. Rows with null ids are told apart.
    A null text is empty; empty texts are copies of each other. All columns stay, whatever their
    names; an empty table stays empty.
    """
    (key,) = fresh(docs, "key")
    keyed = with_long_ids(docs, "doc_id", key)
    leaders = near_classes(keyed.select(F.col(key).alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias(key)).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = keyed.join(leaders, key, "left_semi").groupBy(key).agg(F.min_by(whole, F.xxhash64(whole)).alias("row"))
    return kept.select("row.*")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_classes of all documents; see there for nulls, empty texts, repeated rows and empty tables."""
    return near_classes(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT min(doc_id) AS id, any_value(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, t
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) GROUP BY t),
s AS (
  SELECT id, g, count(*) AS n FROM (
    SELECT id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))
  GROUP BY id, g),
size AS (SELECT id, sum(n) AS total FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, sum(least(a.n, b.n)) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM p JOIN size sx ON sx.id = x JOIN size sy ON sy.id = y WHERE c >= 0.8 * (sx.total + sy.total - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id AS x, id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN sides b ON r.y = b.x),
class AS (SELECT x AS id, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, d.id AS text_id, class_id
FROM documents JOIN d ON d.t = coalesce(text, '') JOIN class ON class.id = d.id
"""
