"""Token ids in ORC files (operator 2).

Documents are dealt into ranges of ascending doc_id, encoded while each range streams
through a task, and written as ORC: integer run-length encoding of the ids, a row index and
Bloom filters on doc_id. Readers split the files by stripes and skip stripes and row groups
by these indexes.

Defined results: a null text counts as empty and gives the end id alone; a null doc_id sorts
first; repeated rows and rows that share a doc_id are written next to each other, in the
order of their texts; an empty table gives no files' rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = 2
#: Words, and pieces, whose ids a worker keeps from task to task; further ones it encodes each time.
CACHE = 400_000
#: Characters whose normal form and lower case are one character, of which letters stand in
#: one piece, each digit alone, other signs in one piece, after the contractions.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level tokenizers show bytes 0x80-0xA0 and 0xAD as the characters from U+0122 on.
SHOWN = {b: 0x122 + b - 0x7F - 1 + 0 for b in range(0x80, 0xA1)} | {0xAD: 0x143}
#: What a tokenizer must give the same ids for either way before words are cut here.
PROBES = ("the", "The.", "don't", "it'S", "'sx", "a1b22,,c", "x<y>", "Éàü\u00dfÿ", "\u00c0b-c", "na\u00efve's", "#$%&12.5", "\u00f8\u00e0", "\u00e1\u00c1\u00ed")
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}
SCHEMA = "doc_id long, start long, n_tokens long, ids array<int>"


class WordIds(dict):
    """Word (bytes without ASCII white space) -> its ids as little-endian uint32 bytes.

    For tokenizers that cut at white space and drop it, the ids of a text are those of its
    words in turn, so each word goes through the tokenizers library once. If the tokenizer
    works as `PLAIN` and its comment say, words of plain characters are cut here and their
    pieces given straight to the library's model; all other words take the library's whole
    chain. Both ways give the same ids.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.pieces = self.tokenizer.model, {}
        self.bytes = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.plain = all(self._cut(w) == self._whole(w) for w in PROBES)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
        at = self.bytes
        return b"".join([at[t.id] for t in self.model.tokenize(shown)])

    def _cut(self, word: str) -> bytes:
        pieces = PIECES.findall(word.lower())
        if len(pieces) == 1:  # the word's own entry is enough
            return self.pieces.get(pieces[0]) or self._piece(pieces[0])
        out: list[bytes] = []
        for piece in pieces:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(self.pieces) < CACHE:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def __missing__(self, word: bytes) -> bytes:
        if self.plain and word.isalpha():  # ASCII letters: one piece
            out = self._piece(word.decode("ascii").lower())
        else:
            text = word.decode("utf-8")
            out = self._cut(text) if self.plain and PLAIN.fullmatch(text) and "<|" not in text else self._whole(text)
        if len(self) < CACHE:
            self[word] = out
        return out

    def encode(self, text: str | None, end: bytes) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split())) + end


@lru_cache(1)
def word_ids(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> DataFrame:
    """SCHEMA rows in ascending doc_id; start counts the ids before in the same partition."""
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, done = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            parts = [words.encode(t.as_py(), end) for t in batch.column(1)]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            ends = np.cumsum(sizes)
            ids = np.frombuffer(b"".join(parts), "<u4").view(np.int32)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "start", "n_tokens", "ids"])
            done += int(ends[-1]) if len(ends) else 0

    return ranged.mapInArrow(run, SCHEMA)


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, **how) -> None:
    encoded(docs, tokenizer_path, **how).write.options(**ORC).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA and the number of the part each row lies in. Filters on doc_id are pushed to
    the files' indexes; columns that are not asked for are not read."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    return spark.read.schema(SCHEMA).orc(path).select("doc_id", "start", "n_tokens", "ids", part.alias("part"))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids in all earlier parts. One row a file, which the driver lists anyway."""
    sums = sorted(read_token_ids(spark, path).groupBy("part").agg(F.sum("n_tokens")).collect())
    before = accumulate((n for _, n in sums), initial=0)
    return spark.createDataFrame([(p, b) for (p, _), b in zip(sums, before)], "part int, before long")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: each document's global start, number of ids and CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = read_token_ids(spark, path).join(F.broadcast(part_starts(spark, path)), "part")
    return rows.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
