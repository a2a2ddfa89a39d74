"""Removal of exact repeats of 20 words or more, found by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of ten words; every run of ten words at any
place probes that index. A window of 20 words holds a whole block, so each repeated window has a
block that is hit. Runs are dealt by hash. What travels is packed per task and bucket: of a run 32
bits beyond its bucket and 16 bits of its place, so runs only need to meet, not to be compared; a run
that occurs twice within a task is a hit at once and is sent once, so no passage fills a bucket.

Hits are extended: the windows around them are hashed with 64 bits beyond their bucket, and each
task sends the first place of each window. The first of all places keeps its words; all other
windows remove theirs, which is what maximal exact repeats of earlier text cover. Texts are dealt by
id once, and read for both the extension and the removal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, fresh, with_long_ids
from causeway.llm.word_hashes import mix, run_hashes, word_hashes

WINDOW = 20
BLOCK = WINDOW // 2
#: Bytes of text a task handles at once, and bytes of text whose runs make one bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 8
_PACKED = "bucket int, done boolean, ids binary, highs binary, counts binary, places binary, hashes binary"


def _raw(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "replace")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    for b in batches:
        sizes, at, held = b["text"].str.len().fillna(0).to_numpy(), 0, 0
        for k, n in enumerate(sizes):
            held += n
            if held >= CHUNK_BYTES or k == len(sizes) - 1:
                some = b.iloc[at : k + 1]
                yield some, [_raw(t) for t in some["text"]]
                at, held = k + 1, 0


def _places(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs inside a document: index among the chunk's words, document, place in the document."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(owner)) - starts[owner]
    inside = np.flatnonzero(place + length <= counts[owner])
    return inside, owner[inside], place[inside]


def _pack(bucket: np.ndarray, ids: np.ndarray, place: np.ndarray, hashes: np.ndarray | None) -> pd.DataFrame:
    """One row per bucket, of places ordered by document; without hashes they are done and only pass through."""
    by = np.argsort(bucket, kind="stable")
    bucket, ids, place = bucket[by], ids[by], place[by]
    high = place >> 16
    new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1]) | (high[1:] != high[:-1])])) if len(by) else by
    counts = np.diff(np.append(new, len(by)))
    names, first = np.unique(bucket, return_index=True)
    seg = np.searchsorted(new, np.append(first, len(by)))
    rows = []
    for k, b in enumerate(names):
        s, e = slice(seg[k], seg[k + 1]), slice(first[k], first[k + 1] if k + 1 < len(names) else len(by))
        rows.append((
            b, hashes is None, ids[new[s]].astype("<i8").tobytes(), high[new[s]].astype("<i4").tobytes(), counts[s].astype("<i4").tobytes(),
            place[e].astype("<u2").tobytes(), b"" if hashes is None else hashes[by[e]].tobytes(),
        ))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PACKED.split(", ")])


def _unpack(rows: pd.DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, place, hash) of all rows of a bucket."""
    get = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
    counts = get("counts", "<i4")
    return np.repeat(get("ids", "<i8"), counts), np.repeat(get("highs", "<i4").astype(np.int64) << 16, counts) + get("places", "<u2"), get("hashes", kind)


def _by_id(ids: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    by = np.argsort(ids, kind="stable")
    ids, places = ids[by], places[by].astype(np.int32)
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else by
    return pd.DataFrame({"id": ids[new], "places": np.split(places, new[1:]) if len(ids) else []})


def _groups(h: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by h (and then by others), each group's first in that order, and each group's size."""
    by = np.lexsort((*then[::-1], h)) if then else np.argsort(h, kind="stable")
    s = h[by]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else by
    return by, first, np.diff(np.append(first, len(s)))


def _met(dealt: DataFrame, judge, buckets: int) -> DataFrame:
    """(id, places) that judge(rows) picks in each bucket, and those that were done before; one row a document.

    What buckets find is packed once more, dealt by document, so that rows don't multiply with buckets.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows["done"].to_numpy(bool)
        ids, places, _ = _unpack(rows[done], "<u4")
        found = judge(rows[~done])
        ids, places = np.concatenate([ids, found[0]]), np.concatenate([places, found[1]])
        by = np.lexsort((places, ids))
        return _pack((mix(ids[by].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), ids[by], places[by], None)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        return _by_id(*_unpack(rows, "<u4")[:2])

    return dealt.groupBy("bucket").applyInPandas(work, _PACKED).groupBy("bucket").applyInPandas(gather, "id long, places array<int>")


def anchor_hits(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, places) of docs (id, text): where ten-word runs start that occur elsewhere, once at least as a block."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, raws in _chunks(batches):
            words, counts = word_hashes(raws)
            inside, owner, place = _places(counts, BLOCK)
            h, ids = run_hashes(words, BLOCK)[inside] if len(inside) else np.zeros(0, np.uint64), b["id"].to_numpy(np.int64)[owner]
            by, first, size = _groups(h)
            often = np.repeat(size > 1, size)
            local = np.sort(by[often])
            # of a run that occurs twice here one place goes on, a block if there is one
            twice = by[often]
            twice = twice[np.lexsort((place[twice] % BLOCK != 0, h[twice]))]
            lead = twice[np.concatenate([[True], h[twice][1:] != h[twice][:-1]])] if len(twice) else twice
            send = np.sort(np.concatenate([by[~often], lead]))
            yield _pack((h[send] % np.uint64(buckets)).astype(np.int64), ids[send], place[send], (h[send] // np.uint64(buckets)).astype("<u4"))
            yield _pack(owner[local] % buckets, ids[local], place[local], None)

    def judge(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, places, h = _unpack(rows, "<u4")
        if not len(h):
            return ids, places
        by, first, size = _groups(h)
        block = np.logical_or.reduceat((places % BLOCK == 0)[by], first)
        hit = by[np.repeat((size > 1) & block, size)]
        return ids[hit], places[hit]

    return _met(docs.mapInPandas(probe, _PACKED), judge, buckets)


def later_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, places) of docs (id, text, places of hits): windows around hits that start earlier elsewhere."""

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, raws in _chunks(batches):
            words, counts = word_hashes(raws)
            inside, owner, place = _places(counts, WINDOW)
            starts = np.cumsum(counts) - counts
            hit = np.zeros(len(words) + WINDOW + 1, np.int32)
            for k, p in enumerate(b["places"]):
                p = np.asarray(p, np.int64)
                hit[starts[k] + p[p < counts[k]]] = 1
            before = np.concatenate([[0], np.cumsum(hit)])
            near = before[inside + BLOCK + 1] > before[inside]
            inside, owner, place = inside[near], owner[near], place[near]
            if not len(inside):
                continue
            h = run_hashes(words, WINDOW)[inside]
            other = run_hashes(word_hashes(raws, seed=1)[0], WINDOW)[inside]
            ids = b["id"].to_numpy(np.int64)[owner]
            by, first, _ = _groups(h, other, ids, place)
            new = np.zeros(len(by), bool)
            new[first] = True
            # windows of equal h and another second hash are not equal
            s = other[by]
            new[1:] |= s[1:] != s[:-1]
            lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            # a repeated row has the places of its first
            later = (ids[by] != ids[lead]) | (place[by] != place[lead])
            send, local = np.sort(by[new]), np.sort(by[later])
            yield _pack((other[send] % np.uint64(buckets)).astype(np.int64), ids[send], place[send], h[send].astype("<u8"))
            yield _pack(owner[local] % buckets, ids[local], place[local], None)

    def judge(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, places, h = _unpack(rows, "<u8")
        by, first, _ = _groups(h, ids, places)
        i, p = ids[by], places[by]
        lead = np.repeat(first, np.diff(np.append(first, len(by))))
        later = (i != i[lead]) | (p != p[lead])
        return i[later], p[later]

    return _met(docs.mapInPandas(extend, _PACKED), judge, buckets)


def without_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """docs with n_words, n_removed and kept_text; columns of docs with these names are replaced.

    A word goes if a window of 20 words covers it that also starts earlier, in a document of a smaller
    id or before in its own; kept words are joined by one space. Windows are judged on the input. A
    null text has no words. Texts of any length are read whole. Rows with equal ids count as one
    document: repeated rows don't remove each other's words, and other columns come from the one of
    them with the smallest hash; if their texts differ, each also loses the places at which the others
    repeat something. Rows with null ids come before all others, in no special order.
    Other columns stay, whatever their names. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in {"n_words", "n_removed", "kept_text"}]
    (key,) = fresh(docs, "key")
    keyed = with_long_ids(docs, row_id, key, -(1 << 62))
    # both joins below deal the same two columns by the same key, so the texts move once
    plain = keyed.select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    found = plain.join(anchor_hits(plain, buckets), "id")
    later = later_windows(found.select("id", "text", "places"), buckets)

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def remove(texts: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for t, places in zip(texts, windows, strict=True):
            words = kept = _raw(t).split()
            if places is not None and len(places):
                at, edge = np.asarray(places, np.int64), np.zeros(len(words) + 1, np.int32)
                at = at[at + WINDOW <= len(words)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    joined = plain.join(later, "id", "left")
    rest = [c for c in others if c not in {row_id, text}]
    if rest:
        whole = F.struct(*[F.col(f"`{c}`") for c in rest])
        one = keyed.select(F.col(key).alias("id"), whole.alias("row")).groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        joined = joined.join(one, "id")
    back = F.when(F.col("id") >= -(1 << 61), F.col("id")).cast(docs.schema[row_id].dataType).alias("id")
    told = joined.select(back, "text", *(["row"] if rest else []), remove(F.col("text"), F.col("places")).alias("told"))
    given = {row_id: F.col("id"), text: F.col("text")} | {c: F.col(f"row.`{c}`") for c in rest}
    return told.select(*[given[c].alias(c) for c in others], "told.*")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What without_repeats leaves of all documents; see there for nulls, empty texts, repeated rows and empty tables."""
    kept = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 20)) AS k)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.i = w.i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
