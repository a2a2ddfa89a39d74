"""The lattice of all segmentations of strings into the pieces of an existing vocabulary.

Many short strings are handled at once with numpy. Nodes are (place, string) pairs numbered by place
first, so all edges into one place of all strings are neighbours and one step of the recursion is a
few array operations. Strings are ordered by length, longest first. A character without a piece of
its own gets a byte piece, or an edge that stands for its UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE_MARK = "▁"
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 20


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Pieces:
    """The vocabulary of a SentencePiece model file, with a hash table of all prefixes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(self.size)])
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.raw = [p.replace(SPACE_MARK, " ").encode() if ok else b"" for p, ok in zip(names, self.normal, strict=True)]
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        found: dict[str, int] = {}
        for i in np.flatnonzero(self.normal):
            p = names[i]
            for n in range(1, len(p)):
                found.setdefault(p[:n], -1)
            found[p] = int(i)
        self._keys = np.zeros(1 << _BITS, np.uint64)
        self._entry = np.full(1 << _BITS, -2, np.int32)
        mask = (1 << 64) - 1
        for text, i in found.items():
            h = int(_SEED)
            for c in text:
                h = ((h ^ ord(c)) * int(_STEP)) & mask
                h ^= h >> 29
            slot = h >> (64 - _BITS)
            while self._entry[slot] != -2:
                slot = (slot + 1) & ((1 << _BITS) - 1)
            self._keys[slot], self._entry[slot] = h, i

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """For each hash its piece, -1 for a prefix that is no piece, -2 for neither."""
        slot = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        out = self._entry[slot]
        wrong = np.flatnonzero((out != -2) & (self._keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << _BITS) - 1)
            out[wrong] = self._entry[slot[wrong]]
            wrong = wrong[(out[wrong] != -2) & (self._keys[slot[wrong]] != h[wrong])]
        return out

    def lattice(self, strings: list[str]) -> Lattice:
        return Lattice(self, strings)

    def unigram(self, alpha: float) -> np.ndarray:
        """Log weights from the vocabulary's own scores, flattened by alpha and normalised.

        Pieces that its scores exclude (-1e9) have no weight, but for the lone space, which every word needs.
        """
        usable = self.normal & (self.score > -1e8)
        lone = self.normal & ~usable & np.array([r == b" " for r in self.raw])
        x = np.where(usable, alpha * self.score, -np.inf)
        x[self.byte_id] = x[lone] = alpha * self.score[usable].min()
        return x - np.log(np.exp(x).sum())

    def edge_weights(self, piece: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log weights of edges; those that stand for bytes get the sum over the bytes."""
        w = logp[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            points, back = np.unique(-1 - piece[odd], return_inverse=True)
            w[odd] = np.array([logp[self.byte_id[list(as_bytes(c))]].sum() for c in points])[back]
        return w


def as_bytes(point: int) -> bytes:
    return chr(point).encode("utf-8", "replace")


class Lattice:
    """order: place of each given string after sorting by length. An edge's piece is -1 - code point if it stands for bytes."""

    def __init__(self, vocabulary: Pieces, strings: list[str]):
        given = np.fromiter(map(len, strings), np.int64, len(strings))
        self.order = np.argsort(-given, kind="stable")
        lens = self.lens = given[self.order]
        n, longest = len(strings), int(lens[0]) if len(strings) else 0
        per_level = np.concatenate([[n], np.cumsum(np.bincount(lens, minlength=longest + 1)[::-1])[::-1][1:]]) if n else np.zeros(1, np.int64)
        base = self.base = np.concatenate([[0], np.cumsum(per_level)])
        points = np.frombuffer("".join([strings[k] for k in self.order]).encode("utf-32-le", "surrogatepass"), np.uint32)
        string = np.repeat(np.arange(n), lens)
        at = np.arange(len(points)) - np.repeat(np.cumsum(lens) - lens, lens)
        char = np.zeros(int(base[-1]), np.uint64)
        char[base[at] + string] = points
        # nodes that have a character after them, in their order
        has = per_level[1:]
        at = np.repeat(np.arange(longest), has)
        string = np.arange(len(at)) - np.repeat(np.cumsum(has) - has, has)
        left = lens[string] - at
        h = np.full(len(at), _SEED)
        src, dst, piece = [], [], []
        size = 0
        while len(at):
            size += 1
            ahead = char[base[at + size - 1] + string]
            h = (h ^ ahead) * _STEP
            h ^= h >> np.uint64(29)
            entry = vocabulary._look_up(h)
            if size == 1:
                ahead = ahead.astype(np.int64)
                odd = np.where(ahead < 128, vocabulary.byte_id[ahead & 127], -1 - ahead)
                edge, p = slice(None), np.where(entry >= 0, entry, odd)
            else:
                edge = np.flatnonzero(entry >= 0)
                p = entry[edge]
            src.append(base[at[edge]] + string[edge])
            dst.append(base[at[edge] + size] + string[edge])
            piece.append(p.astype(np.int64))
            more = np.flatnonzero((entry != -2) & (left > size))
            at, string, left, h = at[more], string[more], left[more], h[more]
        if src:
            src, dst, piece = (np.concatenate(x) for x in (src, dst, piece))
            by = np.argsort(dst, kind="stable")
            self.src, self.dst, self.piece = src[by], dst[by], piece[by]
        else:
            self.src = self.dst = self.piece = np.zeros(0, np.int64)
        self.n, self.n_nodes = n, int(base[-1])
        #: the first edge into each node
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.dst, minlength=self.n_nodes))])
        self.final = base[lens] + np.arange(n)

    def forward(self, w: np.ndarray) -> np.ndarray:
        """For each node the log of the summed weight of all ways to it; w are the edges' log weights."""
        alpha = np.zeros(self.n_nodes)
        for level in range(1, len(self.base) - 1):
            nodes = slice(self.base[level], self.base[level + 1])
            starts = self.first[nodes]
            e = slice(starts[0], self.first[nodes.stop])
            x = alpha[self.src[e]] + w[e]
            cuts = starts - starts[0]
            top = np.maximum.reduceat(x, cuts)
            each = np.diff(np.append(cuts, len(x)))
            alpha[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, each)), cuts))
        return alpha

    def expected(self, w: np.ndarray, alpha: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each edge how often it is used, when the k-th given string is seen weight[k] times."""
        gamma = np.zeros(self.n_nodes)
        gamma[self.final] = weight[self.order]
        share = np.exp(alpha[self.src] + w - alpha[self.dst])
        for level in range(len(self.base) - 2, 0, -1):
            e = slice(self.first[self.base[level]], self.first[self.base[level + 1]])
            share[e] *= gamma[self.dst[e]]
            np.add.at(gamma, self.src[e], share[e])
        return share
