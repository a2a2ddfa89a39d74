"""Sampled segmentations of texts into existing SentencePiece pieces, and lossless decoding.

A text becomes the string " " + text with spaces as U+2581. No piece with a weight runs over a space
(those of several spaces are unused by the vocabulary's score, and have weight zero), so the string is cut before each one into short parts that are drawn independently. Each part's
lattice is filtered forward (summed weights of all ways to each place), then walked backward from
its end, drawing each edge with its share of the weight at its end. Draws are hashes of the seed,
the row key, the part's number and the step, so a row gives the same ids in any partitioning.
Weights are the vocabulary's scores, flattened by alpha. A worker keeps the lattices of a bounded
number of parts for later texts.

Literal U+2581 and all characters without a piece become byte pieces, so decoding gives back the
text, character by character.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents
from causeway.llm.piece_lattice import SPACE_MARK, Pieces, as_bytes, pieces
from causeway.llm.word_hashes import mix

MODEL_FILE = "piece_bpe_32k.model"
ALPHA = 1e-4
#: Characters handled at once; a longer text is handled alone.
CHUNK_CHARS = 120_000
#: Parts whose lattices a worker keeps.
KEPT_PARTS = 60_000
#: Parts over this length are also cut before line ends.
LONG_PART = 100
#: Within parts, for a literal U+2581 and for a part that follows no space; no text has these characters.
_LITERAL, _INSIDE = "\udc81", "\udc82"


def model_path(name: str = MODEL_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(text: str) -> list[str]:
    """The parts between spaces; each stands for a space and itself, unless _INSIDE leads it."""
    if SPACE_MARK in text:
        text = text.replace(SPACE_MARK, _LITERAL)
    parts = text.split(" ")
    if "\n" in text and max(map(len, parts)) > LONG_PART:
        parts = [q for p in parts for q in (p.replace("\n", f"\x00{_INSIDE}\n").split("\x00") if len(p) > LONG_PART and "\x00" not in p else [p])]
    return parts


def _expand(vocabulary: Pieces, ids: np.ndarray) -> np.ndarray:
    """Byte pieces in place of edges that stand for bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    out, at = [], 0
    for k in odd:
        point = -1 - int(ids[k])
        raw = SPACE_MARK.encode() if chr(point) == _LITERAL else as_bytes(point)
        out += [ids[at:k], vocabulary.byte_id[list(raw)]]
        at = k + 1
    return np.concatenate([*out, ids[at:]])


class Sampler:
    """Draws segmentations; holds the lattices of the parts it has seen, up to KEPT_PARTS."""

    def __init__(self, vocabulary: Pieces, alpha: float):
        self.vocabulary, self.logp = vocabulary, vocabulary.unigram(alpha)
        self.final: dict[str, int] = {}
        #: by node: its first edge; by edge: node before it, piece, and the upper end of its range of draws at its node
        self.first, self.src, self.piece = np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.upto = np.zeros(0)

    def _with(self, new: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tables of self and of new parts. Nodes before which nothing stands are their own source."""
        strings = [p[1:] if p[:1] == _INSIDE else SPACE_MARK + p for p in new]
        lattice = self.vocabulary.lattice(strings)
        w = self.vocabulary.edge_weights(lattice.piece, self.logp)
        alpha = lattice.forward(w)
        upto = np.exp(alpha[lattice.src] + w - alpha[lattice.dst])
        rank = np.arange(len(upto)) - lattice.first[lattice.dst]
        for r in range(1, int(rank.max(initial=0)) + 1):
            later = np.flatnonzero(rank == r)
            upto[later] += upto[later - 1]
        upto[lattice.first[1:][np.diff(lattice.first) > 0] - 1] = 2.0
        nodes, edges = len(self.first) - 1, len(self.src)
        src = np.where(lattice.src < lattice.n, -1, lattice.src + nodes)
        place = np.empty(lattice.n, np.int64)
        place[lattice.order] = np.arange(lattice.n)
        final = dict(zip(new, (lattice.final[place] + nodes).tolist(), strict=True))
        join = lambda a, b: np.concatenate([a, b.astype(a.dtype)])
        return final, join(self.first[:-1], lattice.first + edges), join(self.src, src), join(self.piece, lattice.piece), join(self.upto, upto)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """The sampled piece ids of each text; keys are unsigned 64-bit, one a text."""
        per_text = [_parts(t) for t in texts]
        sizes = np.fromiter(map(len, per_text), np.int64, len(texts))
        known: defaultdict[str, int] = defaultdict(count(-2, -1).__next__, self.final)
        node = np.fromiter(map(known.__getitem__, chain.from_iterable(per_text)), np.int64, int(sizes.sum()))
        new = list(known)[len(self.final) :]
        final, first, src, piece, upto = self._with(new)
        fresh = np.flatnonzero(node < 0)
        node[fresh] = np.fromiter(final.values(), np.int64, len(final))[-2 - node[fresh]] if len(fresh) else 0
        if len(self.final) + len(new) <= KEPT_PARTS:
            self.final |= final
            self.first, self.src, self.piece, self.upto = first, src, piece, upto
        number = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stream = mix(np.repeat(keys, sizes) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, steps, taken = np.arange(len(node)), np.zeros(len(node), np.int64), []
        step = 0
        while len(live):
            step += 1
            u = (mix(stream + np.uint64(step * 0xA0761D6478BD642F % 2**64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            edge = first[node]
            wait = np.flatnonzero(u >= upto[edge])
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] >= upto[edge[wait]]]
            taken.append((live, piece[edge]))
            steps[live] = step
            node = src[edge]
            more = np.flatnonzero(node >= 0)
            live, node, stream = live[more], node[more], stream[more]
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (part, ids) in enumerate(taken):
            out[ends[part] - 1 - k] = ids
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return [_expand(self.vocabulary, out[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=1)
def sampler(path: str, alpha: float) -> Sampler:
    return Sampler(pieces(path), alpha)


def decode(vocabulary: Pieces, ids: np.ndarray | list[int]) -> str:
    """The text of ids that sample() made."""
    raw = vocabulary.raw
    return b"".join([raw[i] for i in ids]).decode("utf-8")[1:]


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    at = chars = 0
    for k, t in enumerate(texts):
        chars += len(t or "")
        if chars >= CHUNK_CHARS or k == len(texts) - 1:
            yield slice(at, k + 1)
            at, chars = k + 1, 0


def row_key(seed: int, row_id: Column) -> Column:
    return F.xxhash64(F.lit(seed), row_id.cast("string"))


def encode(docs: DataFrame, text: str = "text", row_id: str = "doc_id", seed: int = 0, alpha: float = ALPHA, model: str | None = None) -> DataFrame:
    """docs with piece_ids, a sampled segmentation per row; a column of docs with this name is replaced.

    A null text has null ids; an empty one has the ids of a lone space. Rows with equal id and text
    have equal ids, other rows with equal text are drawn anew; a null id is a key like others. An
    empty table stays empty.
    """
    path = model or model_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series, keys: pd.Series) -> pd.Series:
        draw, out = sampler(path, alpha), []
        given, hashed = texts.tolist(), keys.to_numpy(np.int64).view(np.uint64)
        for s in _chunks(given):
            got = draw.sample([t or "" for t in given[s]], hashed[s])
            out += [None if t is None else g.astype(np.int32) for t, g in zip(given[s], got, strict=True)]
        return pd.Series(out, dtype=object)

    return docs.withColumn("piece_ids", ids(F.col(text), row_key(seed, F.col(row_id))))


def decoded(docs: DataFrame, ids: str = "piece_ids", model: str | None = None) -> DataFrame:
    """docs with decoded_text; null ids give null. A column of docs with this name is replaced."""
    path = model or model_path()

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        vocabulary = pieces(path)
        return pd.Series([None if r is None else decode(vocabulary, r.tolist()) for r in rows], dtype=object)

    return docs.withColumn("decoded_text", text(F.col(ids)))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes again, and returns digests of both: n_pieces, ids_crc32, decoded_sha256, lossless."""
    path = model_path()
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    @F.pandas_udf("n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
    def digests(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        draw, rows = sampler(path, ALPHA), []
        given, hashed = texts.tolist(), keys.to_numpy(np.int64).view(np.uint64)
        for s in _chunks(given):
            for t, g in zip(given[s], draw.sample(given[s], hashed[s]), strict=True):
                back = decode(draw.vocabulary, g.tolist())
                rows.append((len(g), zlib.crc32(g.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == t))
        return pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return docs.withColumn("_d", digests("text", row_key(0, F.col("doc_id")))).select("doc_id", "_d.*")
