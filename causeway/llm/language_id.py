"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector of its letter 1- to 3-grams, hashed into a fixed number of
dimensions. Document frequencies come from all training documents. A bounded sample of labelled
rows per language (SAMPLE_PER_LANGUAGE, chosen by a hash of the id) is clustered on the sphere, so a
language with several kinds of text keeps several centroids. A text takes the language of the
centroid with the highest cosine; one that is far from every centroid is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, fresh

DIMENSIONS = 8192
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 1000
#: Each language's centroids are held by every worker, so there may be so many at most.
MAX_LANGUAGES = 400
#: A text is rejected below this part of the cosine that all but one in a thousand sampled texts reach.
REJECT_PART = 0.5
UNKNOWN = "und"
ROWS = 128


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashed letter 1- to 3-grams of the lower-cased text; any run of non-letters is one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([np.zeros(1, np.uint32), np.where(is_letter, points, 0).astype(np.uint32), np.zeros(1, np.uint32)])
    a = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    a = a * np.uint32(0x9E3779B1)
    two = (a[:-1] ^ (a[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B) + a[1:]
    three = (two[:-1] ^ (a[2:] >> np.uint32(5))) * np.uint32(0xC2B2AE35) + a[2:]
    h = np.concatenate([a[a != 0] + np.uint32(1), two, three])
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(19)).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """One row of gram counts per text; a row of zeros for null and for texts without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for k, t in enumerate(texts):
        if t:
            out[k] = np.bincount(grams(t), minlength=DIMENSIONS)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first starts; x are unit rows."""
    starts = [int(np.argmax(x @ unit(x.mean(0, keepdims=True))[0]))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    centres = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = unit(np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, scores, rejected = [], [], []
        for at in range(0, len(texts), ROWS):
            rows = counts(texts[at : at + ROWS])
            known = rows.any(axis=1)
            if not len(self.langs):
                known[:] = False
                cos = np.zeros((len(rows), 1), np.float32)
            else:
                cos = unit(np.log1p(rows) * self.idf) @ self.centres.T
            best = np.argmax(cos, axis=1)
            top = np.clip(np.where(known, cos[np.arange(len(rows)), best], 0), 0, 1)
            langs += [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            scores.append(top)
            rejected.append(~known | (top < (self.floors[best] if len(self.langs) else 1)))
        return langs, np.concatenate(scores or [np.zeros(0)]).astype(float), np.concatenate(rejected or [np.zeros(0, bool)])


def fit(train: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """The model of labelled rows; those with a null text or label, or without a letter, teach nothing.

    Labels beyond MAX_LANGUAGES are an error: they name something else than languages. Repeated rows
    teach as often as they come.
    """
    train = train.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(row_id).cast("string").alias("i"))
    train = train.where("t is not null and l is not null")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for b in batches:
            texts = b["t"].tolist()
            n += len(texts)
            for t in texts:
                total[:-1] += np.bincount(grams(t), minlength=DIMENSIONS) > 0
        total[-1] = n
        yield pd.DataFrame({"d": np.flatnonzero(total), "n": total[total > 0]})

    df = train.select("t").mapInPandas(frequencies, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMENSIONS + 1)
    for r in df:
        found[r["d"]] = r["n"]
    idf = np.log((1 + found[-1]) / (1 + found[:-1])).astype(np.float32) + np.float32(1)

    # learned languages are few: each has its centroids in every worker
    sizes = {r["l"]: r["n"] for r in train.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return Model(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    part = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))])
    chosen = train.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < F.element_at(part, F.col("l")) * 1_000_000)

    def centroids(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i")
        rows = counts(b["t"].tolist())
        x = unit(np.log1p(rows[rows.any(axis=1)]) * idf).astype(np.float32)
        if not len(x):
            return pd.DataFrame({"l": [], "c": [], "floor": []})
        centres = cluster(x, CENTROIDS)
        floor = REJECT_PART * float(np.quantile((x @ centres.T).max(axis=1), 0.001))
        return pd.DataFrame({"l": b["l"].iloc[0], "c": list(centres), "floor": floor})

    got = chosen.groupBy("l").applyInPandas(centroids, "l string, c array<float>, floor double").collect()
    got.sort(key=lambda r: (r["l"], r["c"]))
    return Model(idf, [r["l"] for r in got], np.array([r["c"] for r in got], np.float32).reshape(-1, DIMENSIONS), np.array([r["floor"] for r in got]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected; columns of docs with these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. A text of any length
    is read whole. Equal texts get equal results; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def label(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    kept = docs.drop("lang_pred", "score", "rejected")
    (told,) = fresh(kept, "told")
    return kept.withColumn(told, label(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], f"{told}.*")


def held_out(row_id: Column, folds: int) -> Column:
    return F.crc32(row_id.cast("string")) % folds == 1


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, the held-out third taught nothing; see identify() for nulls, empty texts, repeated rows and empty tables."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(held_out(F.col("doc_id"), 3), F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")
