"""Packing: power-of-two decomposition of documents.

Each document's ids (and an end id) are cut into pieces whose lengths are powers of two: as many
of the longest length as fit, then the binary digits of what remains, longest first. A piece is
a sequence by itself, so no sequence crosses documents and none is padded; pieces of one length
form a bucket, and a batch is drawn from one bucket.

A null or empty text has the end id alone: one piece of length 1. Repeated rows are packed each
for themselves. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import kernels as K
from .tables import table

LONGEST = 4096
#: Documents whose pieces leave a task at once.
SLICE = 500
END = 2
_PART = 1 << 20
_SPACE = re.compile(r"[ \t-\r]")
_CHUNK = re.compile(r"[^ \t-\r]+")
_UNSPACED = re.compile(r"[\x1c-\x1f]")  # str.split() parts words there, the tokenizer does not
_MARKS = ".,!?*$%&#;:"
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # Latin-1 letters, all composed
_plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
_ALPHABET = {b: chr(b) for b in _plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_plain)))}


class _Known(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of chunks without white space.

    The tokenizer never joins characters across white space, nor a letter with a mark after it,
    and lowers every character by itself. So a text's ids are those of its chunks in order, a
    chunk's those of its letters and then its trailing marks, and a chunk of letters is one word
    for the merges, in lower case; composed Latin-1 letters need no normal form.
    """

    def __init__(self, path: str, limit: int) -> None:
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        head = chunk.rstrip(_MARKS)
        if head and len(head) < len(chunk) and head[-1].isascii() and head[-1].isalpha():
            out = self[head] + self[chunk[len(head) :]]
        elif _LETTERS.fullmatch(chunk):
            lower = chunk.lower()
            out = self[lower] if lower != chunk else self._bytes([t.id for t in self.model.tokenize("".join(map(_ALPHABET.__getitem__, chunk.encode())))])
        else:
            out = self._bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = out
        return out

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def _parts(text: str) -> Iterator[str]:
    """A long text cut at white space, so that its words are not all held at once."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + _PART)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


class Encoder:
    """Texts to bytes of ids; remembers at most `limit` chunks."""

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.known = _Known(path, limit)

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if len(text) > _PART:
            return b"".join(map(self._encoded, _parts(text)))
        return self._encoded(text)

    def _encoded(self, text: str) -> bytes:
        chunks = _CHUNK.findall(text) if _UNSPACED.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, chunks))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def lengths(total: int, longest: int = LONGEST) -> list[int]:
    """Powers of two up to `longest` that add up to `total`, in falling order."""
    whole, rest = divmod(total, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if wanted, ids.

    sequence_id is the task's number and a count within the task, as unique as the row's place.
    """
    assert longest & (longest - 1) == 0, "the longest length must be a power of two"
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.claim("packing", encoder.cache_clear)
        encode, sequence = encoder(path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows, start, length, crc, tokens, ids = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    data = encode(text.as_py()) + last
                    total, begin = len(data) // 4, 0
                    for size in lengths(total, longest):
                        piece = data[4 * begin : 4 * (begin + size)]
                        rows.append(i)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        tokens.append(total)
                        if with_ids:
                            ids.append(piece)
                        begin += size
                n = len(rows)
                columns = [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    *(pa.array(v, pa.int64()) for v in (start, length, crc, tokens)),
                    pa.array(np.arange(sequence, sequence + n)), pa.array(np.zeros(n, np.int64)),
                    pa.array([v.bit_length() - 1 for v in length], pa.int32()),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                sequence += n
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)
        K.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids binary" * with_ids)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces with their ids as Parquet, a folder for each length; equal lengths batch without padding."""
    pieces.write.partitionBy("bucket").parquet(path)


def unpack(pieces: DataFrame) -> DataFrame:
    """doc_id and the ids of each document, joined from its pieces; the inverse of pack() where doc_id is unique."""
    parts = F.sort_array(F.collect_list(F.struct("start", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("doc_id").agg(joined.alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
