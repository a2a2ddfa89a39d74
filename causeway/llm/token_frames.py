"""Token ids in files of independent zstandard frames, one frame a document, with a seek table.

A file holds, in order:

* one frame per document: its ids as little-endian unsigned 32-bit integers, with content checksum;
* a skippable frame with the document index: ``CWI1``, the file's place among all files (two
  unsigned 32-bit integers), the number of documents, a byte for each (0: null id) and their ids
  as signed 64-bit integers;
* a skippable frame with the seek table of the zstandard seekable format: for each frame its
  compressed size, its size, and the low 32 bits of the XXH64 of its content.

Any zstandard tool decompresses a whole file; a reader that wants some documents opens the files that
the folder's index names and decompresses their frames alone. Files are committed by Spark's own
writer, so a lost task leaves nothing behind: each file is one record of the text format in ISO-8859-1,
whose writer passes bytes through unchecked, and the record separator is the four bytes that end a
seek table.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import documents, shared_folder, stored

VOCABULARY_FILE = "byte_bpe_50k.json"
END_ID = 0
#: Frames of one file add up to about this many bytes; a larger document has a file of its own.
FILE_BYTES = 8 << 20
#: Distinct parts of texts whose ids a worker keeps.
KEPT_PARTS = 400_000

_INDEX_MAGIC, _SEEK_MAGIC, _END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80


#: Marks that often follow a word.
_MARKS = ".,;:!?"


class _AtSpace(Exception):
    """A part begins or ends with white space, so its ids depend on its neighbours."""


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer, from kept ids of the parts between spaces.

    The tokenizer of byte-level vocabularies splits texts by a fixed pattern before its merges, and
    never within what stands between two spaces unless white space meets white space there. Texts
    in which that happens are cut at white space runs instead; texts with a character on which the
    two pattern engines may differ go through the tokenizer whole.
    """

    #: Special cases of white space, and characters beyond Latin letters and common punctuation.
    _ODD = re.compile("[\x1c-\x1f\x85\xa0\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
    _RUNS = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._model, self._split = self.tokenizer.model, regex.compile(public_tokenizers.PATTERN).findall
        self._special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self._letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        outer = self

        class Kept(dict):
            def __init__(self, lead: str):
                self.lead = lead

            def __missing__(self, part: str) -> bytes:
                if self.lead and (not part or part[0].isspace() or part[-1].isspace()):
                    raise _AtSpace
                ids = outer._of(self.lead, part)
                if len(self) < KEPT_PARTS:
                    self[part] = ids
                return ids

        self._after_space, self._alone = Kept(" "), Kept("")
        self._mark = {m: self._piece("", m) for m in _MARKS}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of(self, lead: str, part: str) -> bytes:
        """The ids of a part; letters alone, or with one mark after them, need no splitting."""
        if not part.isascii() and self._ODD.search(part):
            return self._whole(lead + part)
        if part.isalpha():
            return self._piece(lead, part)
        if part[-1:] in _MARKS and part[:-1].isalpha():
            known = (self._after_space if lead else self._alone).get(part[:-1])
            return (known or self._piece(lead, part[:-1])) + self._mark[part[-1]]
        if self._ODD.search(part):
            return self._whole(lead + part)
        return b"".join([self._piece("", p) for p in self._split(lead + part)])

    def _piece(self, lead: str, p: str) -> bytes:
        if p.isascii() and p.isalpha():
            spelled = "Ġ" + p if lead else p
        else:
            spelled = (lead + p).encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self._special):
            return self._whole(text)
        parts = text.split(" ")
        try:
            if not parts[0] or parts[0][-1].isspace():
                raise _AtSpace
            return self._alone[parts[0]] + b"".join(map(self._after_space.__getitem__, parts[1:]))
        except _AtSpace:
            if self._ODD.search(text):
                return self._whole(text)
            return b"".join(map(self._alone.__getitem__, self._RUNS.findall(text)))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def pack(ids: list[int | None], frames: list[bytes], sizes: list[int], sums: list[int], place: tuple[int, int]) -> bytes:
    """The bytes of one file."""
    known = np.array([i is not None for i in ids], np.uint8)
    index = b"CWI1" + struct.pack("<III", *place, len(ids)) + known.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
    table = np.array([[len(f) for f in frames], sizes, sums], "<u4").T.tobytes()
    seek = table + struct.pack("<IBI", len(frames), _CHECKSUMS, _END_MAGIC)
    return b"".join([*frames, _skippable(_INDEX_MAGIC, index), _skippable(_SEEK_MAGIC, seek)])


class File:
    """One file's index and seek table; reads documents by their place in the file."""

    def __init__(self, content: bytes):
        self._content = content
        n, flags, end = struct.unpack_from("<IBI", content, len(content) - 9)
        if end != _END_MAGIC or not flags & _CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(content, "<u4", 3 * n, len(content) - 9 - 12 * n).reshape(n, 3).astype(np.int64)
        self.sizes, self._sums = table[:, 1], table[:, 2]
        self._ends = np.cumsum(table[:, 0])
        at = (int(self._ends[-1]) if n else 0) + 8
        if content[at : at + 4] != b"CWI1":
            raise ValueError("no document index")
        *place, _ = struct.unpack_from("<III", content, at + 4)
        self.place = tuple(place)
        known = np.frombuffer(content, np.uint8, n, at + 16)
        ids = np.frombuffer(content, "<i8", n, at + 16 + n)
        self.ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]

    def document(self, k: int) -> bytes:
        """The ids of the k-th document, checked; no other frame is decompressed."""
        frame = self._content[self._ends[k - 1] if k else 0 : self._ends[k]]
        raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.sizes[k]))
        if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._sums[k]:
            raise ValueError(f"frame {k} fails its checksum")
        return raw


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, text: str = "text", row_id: str = "doc_id", partitions: int | None = None) -> None:
    """Writes the ids of docs, each document's ids and END_ID, in ascending order of row_id.

    A null text is empty and has END_ID alone; null ids come first; rows with equal ids are ordered by a
    hash of the text. Other columns are not written. An empty table gives an empty folder. The texts are dealt
    once, by ranges of the id.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(row_id).cast("long").alias("i"), F.coalesce(text, F.lit("")).alias("t")).repartitionByRange(n, "i", F.xxhash64("t"))

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, number = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True).compress
        end = np.array([END_ID], "<u4").tobytes()
        ids, frames, sizes, sums, held = [], [], [], [], 0
        for b in batches:
            for i, t in zip(b["i"], b["t"], strict=True):
                raw = encode(t) + end
                ids.append(None if pd.isna(i) else int(i))
                frames.append(squeeze(raw))
                sizes.append(len(raw))
                sums.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                held += len(frames[-1])
                if held >= FILE_BYTES:
                    yield pd.DataFrame({"f": [pack(ids, frames, sizes, sums, (part, number))[:-4]]})
                    ids, frames, sizes, sums, held, number = [], [], [], [], 0, number + 1
        if ids:
            yield pd.DataFrame({"f": [pack(ids, frames, sizes, sums, (part, number))[:-4]]})

    made = dealt.sortWithinPartitions("i", F.xxhash64("t")).mapInPandas(files, "f binary").select(F.col("f").cast("string").alias("value"))
    tail = struct.pack("<I", _END_MAGIC).decode("latin-1")
    made.write.option("encoding", "ISO-8859-1").option("lineSep", tail).option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def index_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, frame): the folder's index as a table in the folder itself, under a name that file readers pass over.

    It is made when it is first asked for, from the files' ends, without decompressing anything. An index
    has a name of its own and counts only once it is whole, and only while the folder holds the files
    that it was made of (names, sizes and times); else a new one is made.
    """
    files = spark.read.format("binaryFile").load(folder)
    listed_ = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    stamp = f"{listed_[0]}-{(listed_[1] or 0) & (1 << 64) - 1:016x}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_index-{stamp}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = "doc_id long, file string, frame int"

    def whole() -> list[str]:
        """The attempts at this index that were written to their end."""
        if not fs.exists(place):
            return []
        tries = [s.getPath() for s in fs.listStatus(place)]
        return sorted(p.toString() for p in tries if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                ids = File(content).ids
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "file": name, "frame": np.arange(len(ids), dtype=np.int32)})

    if not whole():
        made = files.select("path", "content").mapInPandas(listed, schema).sortWithinPartitions("doc_id")
        made.write.parquet(f"{place.toString()}/{uuid.uuid4().hex}")
    return spark.read.schema(schema).parquet(whole()[0])


def read_tokens(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """(part, number, at, doc_id, ids_le) of a folder: file's place, place in it in ids, id, and the ids' bytes.

    With a list of ids, which the caller holds, only the files that hold them are opened, and only
    their frames decompressed.
    """
    wanted = None if ids is None else set(ids)

    def documents_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                f = File(content)
                starts = np.cumsum(f.sizes) - f.sizes
                take = [k for k, i in enumerate(f.ids) if wanted is None or i in wanted]
                for at in range(0, len(take), 1000):
                    some = take[at : at + 1000]
                    yield pd.DataFrame({
                        "part": f.place[0], "number": f.place[1], "at": starts[some] // 4,
                        "doc_id": pd.array([f.ids[k] for k in some], "Int64"), "ids_le": [f.document(k) for k in some],
                    })

    schema = "part int, number int, at long, doc_id long, ids_le binary"
    names: str | list[str] = folder
    if ids is not None:
        names = [r["file"] for r in index_tokens(spark, folder).where(F.col("doc_id").isin(ids)).select("file").distinct().collect()]
        if not names:
            return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(names).select("content").mapInPandas(documents_of, schema)


def with_starts(read: DataFrame) -> DataFrame:
    """read with start, the ids of all documents before; only files' totals are ordered as a whole."""
    files = read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("p"))
    starts = files.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("f")).join(parts, "part")
    return read.join(starts, ["part", "number"]).withColumn("start", F.col("p") + F.col("f") + F.col("at")).drop("p", "f")


def vocabulary_path(name: str = VOCABULARY_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of all documents hold, read back; see write_tokens for nulls, empty texts, repeated rows and empty tables."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder, vocabulary_path())

    @F.pandas_udf("long")
    def crc(raw: pd.Series) -> pd.Series:
        return raw.map(zlib.crc32).astype("int64")

    read = read_tokens(spark, folder)
    digests = stored(read.select("part", "number", "at", "doc_id", (F.length("ids_le") / 4).cast("long").alias("n_tokens"), crc("ids_le").alias("ids_crc32")))
    return with_starts(digests).select("doc_id", "start", "n_tokens", "ids_crc32")
