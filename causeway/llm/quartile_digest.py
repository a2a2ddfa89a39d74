"""Quartile bucket digests: a short string per text whose likeness follows the texts' likeness.

Every byte starts a triplet with the fourth and eighth byte after it (zeros follow the text).
Hashed triplets are counted in 1,024 buckets; a bucket's code is the number of quartiles of all
bucket counts that it exceeds (0 to 3). The digest is ``q1``, a length code and the bucket codes in
hex. The difference of two digests adds up code steps, a step of three counting twice, and steps
between the length codes; it is bounded by what unrelated texts reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, stored

BUCKETS = 1024
SPACING = 4
#: Difference from which two texts count as not alike at all: what unrelated texts have.
BOUND = 1.5 * BUCKETS
LENGTH_STEP = 4
HEAD = "q1"


def codes(text: str) -> tuple[int, np.ndarray]:
    """The length code and the bucket codes of a text."""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw + bytes(2 * SPACING), np.uint8).astype(np.uint32)
    n = len(raw)
    h = b[:n] | (b[SPACING : SPACING + n] << np.uint32(8)) | (b[2 * SPACING :] << np.uint32(16))
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    count = np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    quartiles = np.partition(count, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[
        [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    ]
    code = (count > quartiles[0]).astype(np.int8)
    code += count > quartiles[1]
    code += count > quartiles[2]
    return min(255, round(8 * float(np.log2(1 + n)))), code


def digest(length: int, code: np.ndarray) -> str:
    q = code.reshape(-1, 4).astype(np.uint8)
    return f"{HEAD}{length:02x}{(q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes().hex()}"


def parse(text: str) -> tuple[int, np.ndarray]:
    if not text.startswith(HEAD):
        raise ValueError("not a digest of this format")
    packed = np.frombuffer(bytes.fromhex(text[4:]), np.uint8)
    return int(text[2:4], 16), np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel().astype(np.int8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal digests down to 0 at the bound."""
    steps = np.abs(a[1] - b[1])
    difference = int(steps.sum()) + 3 * int((steps == 3).sum()) + LENGTH_STEP * max(0, abs(a[0] - b[0]) - 1)
    return 1.0 - min(difference, BOUND) / BOUND


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint; null counts as empty. A column of docs with this name is replaced.

    Equal texts, so repeated rows too, have equal fingerprints; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(*codes(t or "")) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", fingerprint(F.col(text)))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], nexts: list[str], known: tuple[int, np.ndarray] | None) -> tuple[pd.DataFrame, tuple | None]:
    """known: the codes of the first next text. Each text's codes serve as those of the next text of the row after it."""
    import hashlib

    rows, after = [], known
    for i, t, nx in zip(ids, texts, nexts, strict=True):
        after = after or codes(nx)
        own, k = codes(t), len(t) // 3
        edited = t[: len(t) - k] + nx[:k]
        ed = codes(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        rows.append((i, len(t), sha, digest(*own), digest(*ed), likeness(own, ed), likeness(own, after)))
        after = own
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]), after


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Digests of each text, of its edited text, and how like they and the next document's are.

    docs has doc_id and text; other columns are dropped. The next document is the one before in
    ascending doc_id, null ids first, equal ids by a hash of the text; after the first comes the last. A null text is empty;
    a lone document is its own next; an empty table gives an empty result; repeated rows follow each
    other. The texts are dealt once by ranges of doc_id; each range is read as a stream, and its
    first document is compared in a second step, with the last one of the range before.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = after = None
        for b in batches:
            for at in range(0, len(b), 1000):
                c = b.iloc[at : at + 1000]
                ids, texts = [None if pd.isna(x) else int(x) for x in c["doc_id"]], c["text"].tolist()
                if first is None:
                    first = last = (int(c["part"].iloc[0]), ids[0], texts[0])
                    ids, texts = ids[1:], texts[1:]
                if ids:
                    out, after = _compared(ids, texts, [last[2], *texts[:-1]], after)
                    last = (first[0], ids[-1], texts[-1])
                    yield out.assign(part=None, first_id=None, first_text=None, last_text=None)
        if first is not None:
            ends = {"part": [first[0]], "first_id": [first[1]], "first_text": [first[2]], "last_text": [last[2]]}
            yield pd.DataFrame({c.split()[0]: [None] for c in RESULT.split(", ")} | ends)

    walked = stored(dealt.mapInPandas(walk, f"{RESULT}, part int, first_id long, first_text string, last_text string"))
    ends = walked.where("part is not null").select("part", "first_id", "first_text", "last_text")
    # one row a range: their numbers are paired, then the texts are fetched by range
    numbers = sorted(r["part"] for r in ends.select("part").collect())
    if not numbers:
        return walked.select(*[c.split()[0] for c in RESULT.split(", ")])
    pairs = spark.createDataFrame(list(zip(numbers, [numbers[-1], *numbers[:-1]], strict=True)), "part int, before int")
    lasts = ends.select(F.col("part").alias("before"), F.col("last_text").alias("next_text"))
    joined = ends.join(pairs, "part").join(lasts, "before").select("first_id", "first_text", "next_text")

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t, nx in zip(b["first_id"], b["first_text"], b["next_text"], strict=True):
                yield _compared([None if pd.isna(i) else int(i)], [t], [nx], None)[0]

    inner = walked.where("part is null").select(*[c.split()[0] for c in RESULT.split(", ")])
    return inner.unionByName(joined.mapInPandas(firsts, RESULT))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_with_next of all documents; see there for nulls, empty texts, ties, repeated rows and empty tables."""
    return compare_with_next(documents(spark, sf_dir))
