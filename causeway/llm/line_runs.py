"""Removal of lines that many documents have, by levelled sorted runs of line hashes.

Documents come in batches. A batch's line keys, as 128-bit hashes with the number of documents that
have them, are merge-anti-joined with the runs so far, which drops keys already known to be frequent,
and what is left becomes a run of its own: a table bucketed and sorted by hash, so that runs are never
shuffled again to be joined. When there are FANOUT runs of one level they are compacted into one of the
next, and counts of equal keys add up. A run's folder is named by the batches it covers; a run within
a wider one has been compacted and counts no more, so a broken compaction leaves nothing behind.

Texts are read twice: for their line keys, and, dealt once, to drop the lines at the places found.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, SPACE_CHARS, UPPER, documents, fresh, looked_up, shared_folder, stored

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FANOUT = 8, 4
_HASH = ["h1", "h2"]
_LOWERED = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, its A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def line_keys(text: Column) -> Column:
    """The distinct keys of a text's lines, in the order of their first lines."""
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_key))


def hashes(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


class LineRuns:
    """The runs in a folder that driver and executors share; opened again, the folder goes on where it was."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = next((b for _, _, b in self._all()), self.buckets)

    def _path(self, *names: str):
        """A Hadoop path in the folder, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _all(self) -> list[tuple[int, int, int]]:
        """(first, last batch, buckets) of every whole run, compacted ones too."""
        path, fs = self._path()
        if not fs.exists(path):
            return []
        found = [(s.getPath(), re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", s.getPath().getName())) for s in fs.listStatus(path)]
        return sorted((int(m[1]), int(m[2]), int(m[3])) for p, m in found if m and fs.exists(self._path(p.getName(), "_SUCCESS")[0]))

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of the runs that count, in order."""
        every = [r[:2] for r in self._all()]
        return [r for r in every if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in every)]

    def _name(self, run: tuple[int, int]) -> str:
        return f"run-{run[0]}-{run[1]}-{self.buckets}"

    def _table(self, run: tuple[int, int]) -> DataFrame:
        name = self._name(run)
        table = f"line_runs_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.folder}/{name}').hex}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet "
            f"CLUSTERED BY (h1) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return self.spark.table(table)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        name, table = self._name((first, last)), f"line_runs_{uuid.uuid4().hex}"
        path, fs = self._path(name)
        fs.delete(path, True)  # what a broken write may have left
        dealt = rows.select(*_HASH, "n").repartition(self.buckets, "h1")
        dealt.write.bucketBy(self.buckets, "h1").sortBy(*_HASH).option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # an external table: its files stay

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (h1, h2, ..) whose key no run has."""
        return self._without(lines, 1)

    def _without(self, rows: DataFrame, least: int) -> DataFrame:
        for r in self.runs():
            rows = rows.join(self._table(r).where(F.col("n") >= least).select(*_HASH), _HASH, "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """The run of a batch: lines has h1 and h2, once for each document and key."""
        runs = self.runs()
        batch = runs[-1][1] + 1 if runs else 0
        counts = lines.groupBy(*_HASH).agg(F.count("*").alias("n"))
        self._write(self._without(counts, self.min_docs), batch, batch)
        self.compact()

    def compact(self) -> None:
        """Merges the last runs as long as fanout of them are of one level."""
        while True:
            runs = self.runs()[-self.fanout :]
            if len(runs) < self.fanout or len({last - first for first, last in runs}) > 1:
                return
            self._write(self._merged(runs), runs[0][0], runs[-1][1])

    def _merged(self, runs: list[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[f"{self.folder}/{self._name(r)}" for r in runs])
        return rows.groupBy(*_HASH).agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys that at least min_docs documents of all batches have."""
        return self._merged(self.runs()).where(F.col("n") >= self.min_docs).select(*_HASH)


def without_common_lines(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """docs with n_lines, n_dropped (long) and kept_text; columns of docs with these names are replaced, others stay.

    A line goes if its key has at least min_chars code points and at least min_docs rows of docs have it;
    other lines stay as they are, joined by a newline. A null or empty text is one empty line, whose key
    is too short. A row counts once however often it repeats a line; repeated rows and rows with equal or
    null ids count each. An empty table gives an empty result. The result is the same for any batches and
    fanout.
    """
    spark = docs.sparkSession
    kept = docs.drop(*(x for x in ("n_lines", "n_dropped", "kept_text") if x != text))
    d1, d2, found = fresh(kept, "d1", "d2", "found")
    who = (F.xxhash64(F.col(f"`{row_id}`"), F.col(f"`{text}`")).alias(d1), F.xxhash64(F.lit(1), F.col(f"`{row_id}`"), F.col(f"`{text}`")).alias(d2))
    every = kept.select(*who, F.posexplode(line_keys(F.col(f"`{text}`"))).alias("at", "key")).where(F.length("key") >= min_chars)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    every.select(d1, d2, "at", *hashes(F.col("key")), F.pmod(d1, F.lit(batches)).alias("batch")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema(f"{d1} long, {d2} long, at int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", min_docs, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select(*_HASH))
    common = stored(runs.frequent())
    hits = looked_up(lines.drop("batch"), common, _HASH).groupBy(d1, d2).agg(F.collect_set("at").alias(found))

    @F.pandas_udf("n_lines long, n_dropped long, kept_text string")
    def drop(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for t, gone in zip(texts, places, strict=True):
            all_lines = (t or "").split("\n")
            if gone is None or not len(gone):
                rows.append((len(all_lines), 0, t or ""))
                continue
            keys = [x.strip(SPACE_CHARS).translate(_LOWERED) for x in all_lines]
            names = list(dict.fromkeys(keys))
            lost = {names[k] for k in gone}
            left = [x for x, k in zip(all_lines, keys, strict=True) if k not in lost]
            rows.append((len(all_lines), len(all_lines) - len(left), "\n".join(left)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_text"])

    joined = kept.withColumns({d1: who[0], d2: who[1]}).join(hits, [d1, d2], "left")
    others = [c for c in kept.columns if c not in {"n_lines", "n_dropped", "kept_text"}]
    (told,) = fresh(joined, "told")
    return joined.select(*[F.col(f"`{c}`") for c in others], drop(F.col(f"`{text}`"), F.col(found)).alias(told)).select(*[F.col(f"`{c}`") for c in others], f"{told}.*")


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What without_common_lines leaves of all documents; see there for nulls, empty texts, repeated rows and empty tables."""
    kept = without_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, i, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT r, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d)),
common AS (SELECT k FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}),
kept AS (SELECT r, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS t FROM lines WHERE k NOT IN (SELECT k FROM common) GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
