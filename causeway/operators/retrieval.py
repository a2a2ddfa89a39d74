"""Retrieval of similar texts and vectors: a stated set of queries against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.storage import checkpointed

#: Vectors in a packed block, and digits in which cosines that differ less are ties.
BLOCK, TIE_DIGITS = 4096, 9
#: Texts in a packed block, queries of a block that are compared at once, and what a block of texts holds.
TEXTS, AT_ONCE, BLOCK_NAMES = 512, 256, ("ids", "norms", "sizes", "terms", "idf", "at", "n")
#: Words, and at most texts, of a block whose terms are counted at once; characters for which there is a part of all terms.
WORDS, PLACES, PART = 2**20, 2**16, 2**24
#: Stands between the words of two rows; what makes the hash of two words of theirs.
BETWEEN, TWO = 0, -7046029254386353131


def hashed_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with name, the words of text in order as 64-bit hashes, in place of text."""
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+").transform(df.withColumn("_t", F.coalesce(text, F.lit(""))))
    return words.withColumn(name, F.transform("_w", lambda x: F.xxhash64(x))).drop("_t", "_w", text)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers with those bytes of all together that have the same weight: high ones are mostly zero, and a shuffle then compresses them."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(x: bytes, kind: type) -> np.ndarray:
    """What _planes was made of."""
    return np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _term_blocks(texts: DataFrame, parts: int) -> DataFrame:
    """Texts (kind, id, words) in blocks of up to WORDS words of one task; a row for each part of all terms that a block has.

    A row has the block's ids if it is the block's first, its terms (all one- and two-word ones of the part, by hash, as gaps), how many
    texts have each, and those texts' places in the block and counts, as bytes.
    """
    cuts = np.array([-(2**63) + i * (2**64 // parts) for i in range(1, parts)], np.int64)

    def blocks(batches):
        made = 0
        for b in batches:
            lists, kinds = b.column("words"), b.column("kind").to_numpy(zero_copy_only=False)
            ends, words, ids = np.cumsum(np.diff(lists.offsets.to_numpy()).astype(np.int64)), lists.flatten().to_numpy(), b.column("id").fill_null(0).to_numpy()
            at = done = 0
            while at < len(ids):
                end = max(at + 1, min(int(np.searchsorted(ends, done + WORDS, "right")), at + PLACES))
                end = next((i for i in range(at + 1, end) if kinds[i] != kinds[at]), end)
                w, owner = words[done : ends[end - 1]], np.repeat(np.arange(end - at, dtype=np.uint16), np.diff(ends[at:end], prepend=done))
                real = w != BETWEEN
                two = real[1:] & real[:-1] & (owner[1:] == owner[:-1])
                h, owner = np.concatenate([w[real], (w[:-1] * TWO + w[1:])[two]]), np.concatenate([owner[real], owner[1:][two]])
                by = np.argsort(h, kind="stable")  # so that owners ascend
                h, owner = h[by], owner[by]
                start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
                n, h, owner = np.diff(np.append(start, len(h))).astype(np.int32), h[start], owner[start]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                terms, many = h[first], np.diff(np.append(first, len(h))).astype(np.int32)
                to = np.concatenate([[0], np.searchsorted(terms, cuts), [len(terms)]])
                use = np.flatnonzero(np.diff(to))
                place = np.append(first, len(h))[to]
                gaps = lambda x: np.diff(x, prepend=0)  # noqa: E731  they ascend
                each = [[gaps(terms[to[i] : to[i + 1]]), many[to[i] : to[i + 1]], owner[place[i] : place[i + 1]], n[place[i] : place[i + 1]]] for i in use]
                block = (TaskContext.get().partitionId() << 32) + made
                some = [ids[at:end].tobytes() if i == 0 else b"" for i in range(len(use))]
                columns = [pa.array([_planes(x[c]) for x in each], pa.binary()) for c in range(4)]
                if len(use):
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(use), pa.int64()), pa.array(use, pa.int32()), pa.array([kinds[at]] * len(use), pa.string()), pa.array(some, pa.binary()), *columns], names=["block", "part", "kind", "ids", "terms", "many", "owners", "n"])
                made, at, done = made + 1, end, int(ends[end - 1])

    return texts.select("kind", "id", "words").mapInArrow(blocks, "block long, part int, kind string, ids binary, terms binary, many binary, owners binary, n binary")


def _known_terms(rows: DataFrame) -> DataFrame:
    """The rows of _term_blocks with found, how many texts of all blocks have each term, and in place of terms those that a query has, and which they are."""

    def known(table):
        terms, many = ([_numbers(x.as_py(), t) for x in table.column(c)] for c, t in (("terms", np.int64), ("many", np.int32)))
        terms = [np.cumsum(x) for x in terms]
        every, which = np.unique(np.concatenate(terms), return_inverse=True)
        found = np.bincount(which, np.concatenate(many), len(every)).astype(np.int64)
        which, asked = np.split(which, np.cumsum([len(x) for x in terms])[:-1]), np.zeros(len(every), bool)
        for w, kind in zip(which, table.column("kind").to_pylist(), strict=True):
            if kind == "q":
                asked[w] = True
        made = {"terms": [x[asked[w]].tobytes() for x, w in zip(terms, which, strict=True)], "asked": [asked[w].tobytes() for w in which], "found": [_planes(found[w]) for w in which]}
        kept = ["block", "part", "kind", "ids", "many", "owners", "n"]
        return pa.table([*[table.column(c) for c in kept], *[pa.array(x, pa.binary()) for x in made.values()]], names=[*kept, *made])

    return rows.groupBy("part").applyInArrow(known, "block long, part int, kind string, ids binary, many binary, owners binary, n binary, terms binary, asked binary, found binary")


def _weighed_texts(rows: DataFrame, total: int) -> DataFrame:
    """Blocks of up to TEXTS texts (kind, ids, norms, sizes, terms, idf, at, n): of each text the terms that a query has, as places at in the block's terms, and their counts n."""

    def weighed(table):
        by = np.argsort(table.column("part").to_numpy())
        column = lambda c, t, read=_numbers: (read(table.column(c)[i].as_py(), t) for i in by)
        ids = next(x for x in column("ids", np.int64, np.frombuffer) if len(x))
        square, held, seen, base = np.zeros(len(ids)), [], [], 0
        for many, owners, n, terms, asked, found in zip(*[column(*c) for c in (("many", np.int32), ("owners", np.uint16), ("n", np.int32), ("terms", np.int64, np.frombuffer), ("asked", bool, np.frombuffer), ("found", np.int64))], strict=True):
            idf = np.log((total + 1.0) / (found + 1.0))
            w = n * np.repeat(idf, many)
            square += np.bincount(owners, w * w, len(ids))
            use = np.flatnonzero(np.repeat(asked, many))
            held.append((owners[use], np.repeat(np.arange(base, base + len(terms), dtype=np.int32), many[asked]), n[use]))
            seen.append((terms, idf[asked]))
            base += len(terms)
        (owners, at, n), (terms, idf) = ([np.concatenate(c) for c in zip(*x, strict=True)] for x in (held, seen))
        order = np.argsort(owners, kind="stable")
        owners, at, n = owners[order], at[order], n[order]
        sizes = np.bincount(owners, minlength=len(ids))
        some, ends = np.flatnonzero(sizes), np.append(0, np.cumsum(sizes))
        out = []
        for i in range(0, len(some), TEXTS):
            mine = some[i : i + TEXTS]
            span = slice(ends[mine[0]], ends[mine[-1] + 1])
            use, place = np.unique(at[span], return_inverse=True)
            least = lambda x: x.astype(np.uint8 if x.max() < 2**8 else np.uint16 if x.max() < 2**16 else np.uint32)
            out.append([ids[mine], np.sqrt(square[mine]), sizes[mine].astype(np.int64), terms[use], idf[use], least(place), least(n[span])])
        kind = table.column("kind")[0].as_py()
        return pa.table([pa.array([kind] * len(out), pa.string()), *[pa.array([x[c].tobytes() for x in out], pa.binary()) for c in range(7)]], names=["kind", *BLOCK_NAMES])

    return rows.groupBy("block").applyInArrow(weighed, f"kind string, {', '.join(f'{c} binary' for c in BLOCK_NAMES)}")


def similar_texts(queries: DataFrame, corpus: DataFrame, text: str = "text", k: int = 5, query_id: str = "item_id", row_id: str = "doc_id") -> DataFrame:
    """(query_id, row_id, cosine, place): the k most alike texts of each query by TF-IDF over all terms of both, through shared terms.

    idf is log((rows + 1) / (rows with the term + 1)). Ties in TIE_DIGITS digits go by row_id. Rows of one id are one
    text, whose terms add up. Blocks of texts are cut into parts by term, so that a task sees all of a part's terms and
    no more: as many parts as PART characters go into all texts. A term that all texts have takes six bytes a text there.
    Weights of terms that no query has go into a text's norm alone; blocks of texts with their other terms meet blocks of
    queries, and of a pair of blocks only the k best texts of each query go on.
    """
    spark = queries.sparkSession
    kind = lambda c, x: F.when(F.col(c).isNull(), "none").otherwise(x).alias("kind")
    sides = [df.select(kind(c, x), F.col(c).cast("long").alias("id"), F.col(text).alias("text")) for df, c, x in ((queries, query_id, "q"), (corpus, row_id, "c"))]
    rows = sides[0].union(sides[1]).groupBy("kind", "id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    total, chars, asked, most = rows.agg(F.sum("n"), F.sum("chars"), F.sum(F.when(F.col("kind") == "q", F.col("n"))), F.max("n")).first()
    total, chars, asked, most = (x or 0 for x in (total, chars, asked, most))
    # queries are dealt so that their blocks are full
    few = max(1, -(-asked // TEXTS))
    words = hashed_words(sides[0].repartition(few).union(sides[1]), "text", "words")
    if most > 1:
        one = F.flatten(F.transform(F.sort_array(F.collect_list("words")), lambda x: F.concat(x, F.array(F.lit(BETWEEN)))))
        words = words.groupBy("kind", "id").agg(one.alias("words")).sortWithinPartitions("kind", "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART))
    blocks = checkpointed(_weighed_texts(_known_terms(_term_blocks(words, parts)), total))
    side = lambda kind, x: blocks.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{x}_{c}") for c in BLOCK_NAMES])
    pairs = side("c", "c").crossJoin(side("q", "q").repartition(few))

    def opened(r, x):
        ids, norms, sizes, terms, idf, at, n = (getattr(r, f"{x}_{c}") for c in BLOCK_NAMES)
        sizes = np.frombuffer(sizes, np.int64)
        at, n = (np.frombuffer(c, f"u{len(c) // sizes.sum()}").astype(np.int64) for c in (at, n))
        return np.frombuffer(ids, np.int64), np.frombuffer(norms), sizes, np.frombuffer(terms, np.int64), at, n * np.frombuffer(idf)[at]

    def best(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                (qi, qn, qs, terms, qt, qw), (ci, cn, cs, other, ct, cw) = opened(r, "q"), opened(r, "c")
                table = np.zeros((len(terms), len(qi)))
                table[qt, np.repeat(np.arange(len(qi)), qs)] = qw
                to = np.minimum(np.searchsorted(terms, other), len(terms) - 1)
                use = np.flatnonzero((terms[to] == other)[ct])
                if not len(use):
                    continue
                owner, at = np.repeat(np.arange(len(ci)), cs)[use], to[ct]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                rows = owner[first]
                dot = np.concatenate([np.add.reduce(cw[part, None] * table[at[part]], axis=0)[None] for part in np.split(use, first[1:])])
                cos = np.where(dot > 0, dot / np.where(qn > 0, qn, 1) / np.where(cn > 0, cn, 1)[rows, None], -1.0).T
                j = ci[rows]
                order = np.lexsort((np.broadcast_to(j, cos.shape), -np.round(cos, TIE_DIGITS)), axis=1)[:, :k]
                top = np.take_along_axis(cos, order, axis=1)
                keep = top > 0
                yield pd.DataFrame({query_id: np.repeat(qi, keep.sum(1)), row_id: j[order][keep], "cosine": top[keep]})

    met = pairs.mapInPandas(best, f"`{query_id}` long, `{row_id}` long, cosine double")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("cosine", TIE_DIGITS)), row_id)
    return met.withColumn("place", F.row_number().over(order)).where(f"place <= {k}")


def packed(df: DataFrame, row_id: str, vector: str, names: tuple[str, str], by: str | None = None) -> DataFrame:
    """Unit vectors in blocks of up to BLOCK rows of one task (and one value of by): ids and vectors as bytes, zero vectors left out."""
    ids, vecs = names
    key = F.col(by).cast("string") if by else F.lit("")

    def pack(batches):
        for b in batches:
            x = np.stack([np.asarray(v, np.float64) for v in b["v"]]) if len(b) else np.zeros((0, 0))
            norm = np.linalg.norm(x, axis=1) if len(b) else np.zeros(0)
            for g in dict.fromkeys(b["g"]):
                use = np.flatnonzero((b["g"] == g).to_numpy() & (norm > 0))
                for at in range(0, len(use), BLOCK):
                    some = use[at : at + BLOCK]
                    yield pd.DataFrame({"g": [g], ids: [b["id"].to_numpy(np.int64)[some].tobytes()], vecs: [(x[some] / norm[some, None]).tobytes()]})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), key.alias("g"))
    return rows.mapInPandas(pack, f"g string, {ids} binary, {vecs} binary")


def nearest(queries: DataFrame, corpus: DataFrame, vector: str, k: int, query_id: str, row_id: str, by: str | None = None, least: float = -2.0) -> DataFrame:
    """(query_id, row_id, cosine, place): exact best k of every query among all rows (with the same value of by).

    Blocks of queries meet blocks of rows; of a pair of blocks only the k best rows of each query go on.
    """
    q, r = packed(queries, query_id, vector, ("qi", "qv"), by), packed(corpus, row_id, vector, ("ri", "rv"), by)
    pairs = q.join(r, "g") if by else q.drop("g").crossJoin(r.drop("g"))

    def best(batches):
        for b in batches:
            for qi, qv, ri, rv in zip(b["qi"], b["qv"], b["ri"], b["rv"], strict=True):
                every, j = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                a, b_ = np.frombuffer(qv).reshape(len(every), -1), np.frombuffer(rv).reshape(len(j), -1)
                for at in range(0, len(every), AT_ONCE):  # a whole block's cosines, and their order, would take half a GB and more
                    i = every[at : at + AT_ONCE]
                    cos = a[at : at + AT_ONCE] @ b_.T
                    tied = np.round(cos, TIE_DIGITS)
                    order = np.lexsort((np.broadcast_to(j, cos.shape), -tied), axis=1)[:, :k]
                    top = np.take_along_axis(cos, order, axis=1)
                    keep = top >= least
                    yield pd.DataFrame({query_id: np.repeat(i, keep.sum(1)), row_id: j[order][keep], "cosine": top[keep]})

    met = pairs.mapInPandas(best, f"`{query_id}` long, `{row_id}` long, cosine double")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("cosine", TIE_DIGITS)), row_id)
    return met.withColumn("place", F.row_number().over(order)).where(f"place <= {k}")


def similar_vectors(queries: DataFrame, corpus: DataFrame, vector: str, k: int = 5, query_id: str = "q", row_id: str = "r") -> DataFrame:
    """(query_id, row_id, cosine, place) by exact cosine of every query with every row, in blocks."""
    return nearest(queries, corpus, vector, k, query_id, row_id)


def cache_lookup(requests: DataFrame, cache: DataFrame, bound: float = 0.95) -> DataFrame:
    """(request, hit, kind, cosine) of requests (request, template, hash, vec) in a cache (entry, template, hash, vec), one row a request.

    Exact (template, hash) first, then the nearest entry of the template by exact cosine if it reaches
    the bound; others miss.
    """
    exact = requests.join(cache, ["template", "hash"]).groupBy("request").agg(F.min("entry").alias("hit")).select("request", "hit", F.lit("exact").alias("kind"), F.lit(1.0).alias("cosine"))
    left = requests.join(exact, "request", "left_anti")
    near = nearest(left, cache, "vec", 1, "request", "entry", "template", bound).select("request", F.col("entry").alias("hit"), F.lit("near").alias("kind"), "cosine")
    missed = left.select("request").join(near, "request", "left_anti").select("request", F.lit(None).cast("long").alias("hit"), F.lit("miss").alias("kind"), F.lit(None).cast("double").alias("cosine"))
    return exact.unionByName(near).unionByName(missed)
