"""Collocations by dynamic itemset counting: phrases of all lengths are counted in the same cyclic scans.

The documents are dealt into shards, and every step scans one of them, in turn and over again. Words are
counted from the first step on; a longer phrase is counted from the step after both its subphrases (all
but the last word, all but the first) reached the threshold, for one full cycle of shards. So shorter
and longer phrases are counted by the same scans, and a scan looks at few phrases that can't be frequent.

What has reached the threshold is a filter of FILTER_BITS bits, whatever the data, that only ever grows.
A scan counts a phrase if the filter of its step admits both subphrases and that of a cycle before did
not: then the phrase is in one full cycle from its admission, which is all its occurrences. Phrases that
the filter admits by chance are counted as completely, and dropped as too rare.

Phrases are 64-bit hashes until they are ranked. A task adds up what it scans before it sends anything;
what is sent and kept is packed by buckets of hashes, so no phrase, however frequent, is many rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, UPPER, documents, looked_up, shared_folder, stored
from causeway.llm.word_hashes import mix, powers, stretches

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: A phrase goes if one that holds it has so many hundredths of its occurrences.
COVER_PERCENT = 80
SCALE = 2_000_000
SHARDS = 4
FILTER_BITS = 1 << 26
#: Bytes of text handled at once, phrases a task holds before it sends them, regions of the filter.
CHUNK_BYTES, HELD, REGIONS = 512 << 10, 1 << 20, 64
#: Salts of the two rounds that pick a language's first phrases.
SALTS = (256, 1)

_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_PACKED = "bucket int, h binary, n binary, k binary, first binary, known binary"


class Words:
    """The words of some texts in a row: where they start and end, their text and piece, and hashes of their runs."""

    def __init__(self, b: np.ndarray, starts: np.ndarray, langs: np.ndarray):
        self.bytes, kind = _LOWERED[b], _KIND[b]
        inside, new = np.zeros(len(b) + 2, bool), np.zeros(len(b) + 1, bool)
        inside[1:-1] = kind == 0
        new[starts] = True
        self.first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | new[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | new[1:])) + 1
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        # texts and marks before a word: equal for two words only in one piece
        self.piece = np.cumsum(kind == 2)[self.first] + self.text if len(b) else self.first
        self.lang = langs.view(np.uint64)[self.text]
        own = mix(stretches(self.bytes.astype(np.uint64) + np.uint64(1), self.first, self.end) + (self.end - self.first).astype(np.uint64))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers(len(own))[0])])

    def runs(self, k: int) -> np.ndarray:
        """Where k words start that stand in one piece."""
        at = np.arange(max(0, len(self.first) - k + 1))
        return at[self.piece[at] == self.piece[at + k - 1]]

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """The hash of the k words from each place, and of their language."""
        run = (self._sums[at + k] - self._sums[at]) * powers(len(self.first) + 1)[1][at]
        return mix(mix(run + np.uint64(k)) ^ self.lang[at])

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.bytes[self.first[at] : self.end[at + k - 1]].tobytes().split()).decode("utf-8", "replace")


def of_language(langs: np.ndarray) -> np.ndarray:
    """What stands for all words of a language."""
    return mix(langs.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of batches of (text, lang_key), some texts at a time, and their rows in the batch; a long text is cut between pieces."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends, langs = ends - ends[0], batch.column("lang_key").to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(data):
            to = min(len(data), at + CHUNK_BYTES)
            while to < len(data):
                cut = np.flatnonzero(_KIND[data[to : to + CHUNK_BYTES]] == 2)
                text_end = ends[np.searchsorted(ends, to)]
                to = min(to + cut[0] + 1 if len(cut) else to + CHUNK_BYTES, text_end)
                if len(cut) or to == text_end:
                    break
            low, high = np.searchsorted(ends, at, side="right") - 1, np.searchsorted(ends, to)
            yield Words(data[at:to], np.maximum(ends[low:high] - at, 0), langs[low:high]), np.arange(low, high)
            at = to


class Filter:
    """A set of hashes in a fixed number of bits; says yes to some others too."""

    def __init__(self, bits: np.ndarray):
        self.bits, self._mask = bits, np.uint64(8 * len(bits) - 1)

    @classmethod
    def sent(cls, broadcast) -> Filter:
        return cls(np.frombuffer(zlib.decompress(broadcast.value), np.uint8))

    def places(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([h & self._mask, (h >> np.uint64(32)) & self._mask])

    def has(self, h: np.ndarray) -> np.ndarray:
        p = self.places(h)
        hit = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return (hit[: len(h)] & hit[len(h) :]).astype(bool)


def frequent_runs(words: Words, k: int, found: dict[int, np.ndarray], now: Filter) -> np.ndarray:
    """Where k words start whose subphrases are both in the filter; found keeps where those of each length are."""
    if k == 1:
        return words.runs(1)
    at = words.runs(k)
    return at[found[k - 1][at] & found[k - 1][at + 1]]


def places_in(words: Words, at: np.ndarray, k: int, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of k words from each place, and a mask over all words of those places that are in the filter."""
    h, mask = words.hashes(at, k), np.zeros(len(words.first) + 1, bool)
    mask[at[f.has(h)]] = True
    return h, mask


def _added(h: np.ndarray, n: np.ndarray, *others: tuple[np.ndarray, np.ufunc]) -> list[np.ndarray]:
    """The distinct hashes in order, their sums, and the others joined by their functions."""
    by = np.argsort(h, kind="stable")
    s = h[by]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else by
    if not len(s):
        return [h, n, *[o for o, _ in others]]
    return [s[new], np.add.reduceat(n[by], new), *[f.reduceat(o[by], new) for o, f in others]]


def _pack(h: np.ndarray, n: np.ndarray, k: np.ndarray, first: int, buckets: int) -> pa.RecordBatch:
    bucket = (h >> np.uint64(40)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[by], return_index=True)
    parts = [by[a:z] for a, z in zip(at, [*at[1:], len(by)], strict=True)]
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(names.astype(np.int32), pa.int32()),
        "h": pa.array([h[p].tobytes() for p in parts], pa.binary()), "n": pa.array([n[p].astype("<i8").tobytes() for p in parts], pa.binary()),
        "k": pa.array([k[p].tobytes() for p in parts], pa.binary()), "first": pa.array([np.full(len(p), first, "<u2").tobytes() for p in parts], pa.binary()),
        "known": pa.array([bytes(len(p)) for p in parts], pa.binary()),
    })


def scan(shard: DataFrame, step: int, shards: int, max_words: int, now, before, buckets: int) -> DataFrame:
    """Packed counts of one shard: of the phrases that now admits and before, a cycle ago, did not; both are broadcast bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admits, done = Filter.sent(now), Filter.sent(before) if before is not None else None
        held: list[list[np.ndarray]] = []
        size = 0
        for words, _ in chunks(batches):
            found: dict[int, np.ndarray] = {}
            gone: dict[int, np.ndarray] = {}
            for k in range(1, max_words + 1):
                at = frequent_runs(words, k, found, admits)
                h, found[k] = places_in(words, at, k, admits)
                take = np.full(len(at), k > 1 or step < shards)
                if done is not None:
                    counted = gone[k - 1][at] & gone[k - 1][at + 1] if k > 1 else np.ones(len(at), bool)
                    take &= ~counted
                    gone[k] = np.zeros(len(words.first) + 1, bool)
                    gone[k][at[counted & done.has(h)]] = True
                if take.any():
                    own = _added(h[take], np.ones(int(take.sum()), np.int64))
                    held.append([*own, np.full(len(own[0]), k, np.uint8)])
                    size += len(own[0])
            if step < shards and len(words.first):
                langs, n = np.unique(words.lang, return_counts=True)
                held.append([of_language(langs), n.astype(np.int64), np.zeros(len(n), np.uint8)])
            if size > HELD:
                h, n, k = (np.concatenate(x) for x in zip(*held, strict=True))
                held = [_added(h, n, (k, np.maximum))]
                size = len(held[0][0])
                if size > HELD:
                    yield _pack(*held[0], step, buckets)
                    held, size = [], 0
        if held:
            h, n, k = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _pack(*_added(h, n, (k, np.maximum)), step, buckets)

    return shard.mapInArrow(work, _PACKED)


def _unpacked(rows: pd.DataFrame) -> list[np.ndarray]:
    kinds = {"h": "<u8", "n": "<i8", "k": np.uint8, "first": "<u2", "known": np.uint8}
    return [np.frombuffer(b"".join(rows[c]), t) for c, t in kinds.items()]


def added_up(packed: DataFrame, step: int, shards: int, min_count: int) -> DataFrame:
    """packed with equal phrases added up, in a row a bucket; fresh are the hashes that reach the threshold now.

    Phrases whose cycle is over and that are below it are dropped.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        h, n, k, first, known = _unpacked(rows)
        h, n, k, first, known = _added(h, n, (k, np.maximum), (first, np.minimum), (known, np.maximum))
        reached = (n >= min_count) & (k > 0)
        fresh = h[reached & (known == 0)]
        keep = (n >= min_count) | (k == 0) | (step - first.astype(int) < shards - 1)
        cells = [h[keep], n[keep], k[keep], first[keep], (known | reached)[keep].astype(np.uint8), fresh]
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy()} | {c: [x.tobytes()] for c, x in zip(["h", "n", "k", "first", "known", "fresh"], cells, strict=True)})

    return packed.groupBy("bucket").applyInPandas(work, f"{_PACKED}, fresh binary")


def grown(bits: np.ndarray, state: DataFrame) -> np.ndarray:
    """The filter's bits with the fresh hashes of state; what is collected has the filter's size at most."""
    size, region = 8 * len(bits), 8 * len(bits) // REGIONS

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.unique(Filter(np.zeros(size // 8, np.uint8)).places(np.frombuffer(b"".join(b["fresh"]), "<u8")))
            r = (p // np.uint64(region)).astype(np.int32)
            names, at = np.unique(r, return_index=True)
            yield pd.DataFrame({"region": names, "places": [(x % np.uint64(region)).astype("<u4").tobytes() for x in np.split(p, at[1:])] if len(names) else []})

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(region, np.uint8)
        on[np.frombuffer(b"".join(rows["places"]), "<u4")] = 1
        return pd.DataFrame({"region": rows["region"].iloc[:1].to_numpy(), "bits": [np.packbits(on, bitorder="little").tobytes()]})

    made = state.select("fresh").where(F.length("fresh") > 0).mapInPandas(places, "region int, places binary")
    out = bits.copy()
    for r in made.groupBy("region").applyInPandas(page, "region int, bits binary").collect():
        at = r["region"] * region // 8
        out[at : at + region // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def broadcast(spark: SparkSession, bits: np.ndarray):
    return spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))


def dealt(docs: DataFrame, text: str, lang: str, shards: int) -> list[DataFrame]:
    """The shards of docs: lang (null: und), lang_key and text in bytes."""
    spark = docs.sparkSession
    name = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(
        name.alias("lang"), F.xxhash64(name).alias("lang_key"), F.col(f"`{text}`").cast("binary").alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"),
    )
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    made = spark.read.schema("lang string, lang_key long, text binary, shard int").parquet(path)
    return [made.where(F.col("shard") == s).drop("shard") for s in range(shards)]


def named(shards: list[DataFrame], counted: DataFrame, bits: np.ndarray, max_words: int) -> DataFrame:
    """(lang, phrase, k, n) of counted (h, n), whose phrases are all in the filter; k is 0 for a language as a whole.

    The first shard names what it holds, and the next ones what is left, so that few tasks send a phrase.
    """
    spark = counted.sparkSession
    done, left, every = None, counted, broadcast(spark, bits)
    for shard in shards:
        wanted = broadcast(spark, grown(np.zeros_like(bits), packed_hashes(left)))
        found = shard.mapInArrow(namer(every, wanted, max_words), "h long, k int, lang string, phrase string")
        one = found.groupBy("h").agg(F.min(F.struct("k", "lang", "phrase")).alias("p"))
        now = stored(left.join(one, "h", "left"))
        names = now.where("p is not null").select("p.lang", "p.phrase", "p.k", "n")
        done = names if done is None else done.unionByName(names)
        left = now.where("p is null").select("h", "n")
        wanted.destroy()
        if left.isEmpty():
            break
    every.destroy()
    return done


def packed_hashes(counted: DataFrame) -> DataFrame:
    """counted's hashes in a row a batch, as grown reads them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fresh": [b["h"].to_numpy(np.int64).tobytes()]})

    return counted.select("h").mapInPandas(pack, "fresh binary")


def namer(bits, wanted, max_words: int):
    """A function of batches that names the phrases in the filter whose hashes are wanted, each once or a few times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, asked, seen = Filter.sent(bits), Filter.sent(wanted), set()
        for batch in batches:
            langs = batch.column("lang")
            for words, rows in chunks(iter([batch])):
                out: list[tuple[int, int, str, str]] = []

                def name(k: int, h: np.ndarray, at: np.ndarray, words=words, rows=rows, langs=langs, out=out) -> None:
                    ask = asked.has(h)
                    known, one = np.unique(h[ask], return_index=True)
                    for x, p in zip(known.tolist(), at[ask][one].tolist(), strict=True):
                        if x not in seen:
                            seen.add(x)
                            out.append((x, k, langs[int(rows[words.text[p]])].as_py(), words.phrase(p, k) if k else ""))

                found: dict[int, np.ndarray] = {}
                for k in range(1, max_words + 1):
                    at = frequent_runs(words, k, found, f)
                    h, found[k] = places_in(words, at, k, f)
                    name(k, h[found[k][at]], at[found[k][at]])
                name(0, of_language(words.lang.view(np.int64)), np.arange(len(words.lang)))
                if out:
                    h, k, lang, phrase = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"h": pa.array(np.array(h, np.uint64).view(np.int64)), "k": pa.array(k, pa.int32()), "lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string())})
                if len(seen) > HELD:
                    seen.clear()

    return work


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    shards: int = SHARDS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, phrase, k, n): phrases of up to max_words words with at least min_count occurrences n in their language.

    Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` and split at spaces and tabs; phrases don't
    reach over a cut. Row k 0 has a language's number of words. A null text has no words, a null language
    is ``und``; repeated rows count each; an empty table gives no rows. Other columns are not read. The
    result is the same for any shards and filter_bits (a power of two), which only say how much is scanned.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = dealt(docs, text, lang, shards)
    bits, past, sent = np.zeros(filter_bits // 8, np.uint8), [], []  # the filters of the last cycle's steps
    state, step = None, 0
    while step < shards or not np.array_equal(bits, past[0]):
        before = sent.pop(0) if step >= shards else None
        past = [*past[-shards + 1 :], bits] if shards > 1 else [bits]
        sent.append(broadcast(spark, bits))
        counts = scan(parts[step % shards], step, shards, max_words, sent[-1], before, buckets)
        state = stored(added_up(counts if state is None else state.drop("fresh").unionByName(counts), step, shards, min_count))
        bits = grown(bits, state)
        if before is not None:
            before.destroy()  # state is stored, and reads it no more
        step += 1

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, n, k, _, _ = _unpacked(b)
            keep = (n >= min_count) | (k == 0)
            yield pd.DataFrame({"h": h[keep].view(np.int64), "n": n[keep]})

    counted = stored(state.mapInPandas(unpack, "h long, n long"))
    for x in sent:
        x.destroy()
    return named(parts, counted, bits, max_words)


def _part(w: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(w, start, n), " ")


def collocations(phrases: DataFrame, top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases, of what frequent_phrases returns.

    A phrase's score is the lowest over its cuts, floor(SCALE * a / (l + r)) with l and r the parts' counts;
    of equally low cuts the first counts. Phrases within a longer one that has cover_percent of their
    occurrences go. Order: score and a descending, phrase ascending by bytes. No phrases, no rows.
    """
    w, k = F.split("phrase", " "), F.col("k")
    candidates = phrases.where(k >= 2)
    cuts = stored(candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "cut", _part(w, F.lit(1), F.col("cut")).alias("left"), _part(w, F.col("cut") + 1, k - F.col("cut")).alias("right")))
    of = phrases.where(k >= 1)
    cuts = stored(looked_up(cuts, of.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]))
    cuts = looked_up(cuts, of.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr(f"cast(a AS decimal(20, 0)) * {SCALE} div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # what stands two words deeper is within a phrase between that occurs as often at least
    held = phrases.where(k >= 3).select("lang", F.explode(F.array(_part(w, F.lit(1), k - 1), _part(w, F.lit(2), k - 1))).alias("phrase"), "n")
    most = held.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    left = best.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover_percent * F.col("a"))).drop("most")
    for salts in SALTS:
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        left = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = phrases.where(k == 0).select("lang", F.col("n").alias("words"))
    return left.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def op11_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations of all documents; see frequent_phrases for nulls, empty texts, repeated rows and empty tables."""
    return collocations(frequent_phrases(documents(spark, sf_dir)))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k))
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cuts AS (
  SELECT lang, phrase, k, a, cut, array_to_string(s[: cut], ' ') AS l_phrase, array_to_string(s[cut + 1 :], ' ') AS r_phrase
  FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = l_phrase JOIN f r ON r.lang = c.lang AND r.phrase = r_phrase),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
left_over AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.a >= {COVER_PERCENT} * b.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
JOIN totals USING (lang) WHERE rank <= {TOP}
"""
