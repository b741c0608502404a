"""SentencePiece encoding and decoding over a relational lattice (operator 4).

Texts are cut into chunks that no piece crosses (at spaces, line ends and before signs that
no piece joins to a letter). For every distinct chunk: its bounded-length substrings are
exploded, equi-joined to the piece table (as large as the model's vocabulary), matches are
grouped by chunk, and a higher-order aggregate folds them: Viterbi for unigram models; for
BPE models, whose ids Viterbi would not give, the merges in order of rank over a bit mask of
the cuts (`monotone` checks that one pass in that order does what the model means).
A chunk stays where the first grouping put it, so grouping its edges moves no row, and the
splits that hold it go along with it: no join brings them back.

Each reader of a split of the texts then takes the ids of that split's own chunks from a
dictionary in the shared folder and writes them in the order of the text; no text is moved.
A chunk that the dictionary lacks (files that were split elsewhere) or that is longer than
`LONG` is encoded in Python, with the same ids.

Defined results: a null or empty text has no ids and decodes to an empty text; decode(encode(t))
is t for every text without U+2581, which stands for a space in this scheme (the dummy space
in front is taken away again; characters without a piece go through byte pieces); repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, give_back, new_path, release, written

SPACE = "▁"
#: Chunks longer than this are folded in Python: a mask of cuts has 63 bits.
LONG = 60
#: Files whose places are in one row of a chunk, at the most about so many.
FILES = 256
#: Words that a reader gathers before it hands their chunks on.
GATHERED = 250_000
#: Documents that a reader turns into ids at a time.
SOME = 1024
#: Chunks whose edges a task groups in memory before it sorts them instead (some 100 MB).
GROUPS = 1 << 18


@dataclass(frozen=True)
class Pieces:
    """What is needed of a model file: pieces by id, their rank, byte pieces, and the kind."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    bpe: bool

    @cached_property
    def longest(self) -> int:
        return max(len(t) for t, u in zip(self.texts, self.usable) if u)

    def rank(self) -> dict[int, int]:
        order = sorted((i for i, u in enumerate(self.usable) if u), key=lambda i: (-self.scores[i], i))
        return {i: r for r, i in enumerate(order)}

    def cut_signs(self) -> str:
        """Signs before a run of which a text may be cut: in every piece, what stands before
        one of them is a space or another of them. ASCII signs and those that they need."""
        pairs = {(x, y) for t, u in zip(self.texts, self.usable) if u for x, y in zip(t, t[1:]) if x != SPACE}
        signs, never = set(string.punctuation), set()
        while open_ := {(x, y) for x, y in pairs if y in signs and x not in signs}:
            never |= {y for x, y in open_ if x.isalpha() or x.isdecimal() or x.isspace() or x in never}
            signs = (signs | {x for x, _ in open_ if not (x.isalpha() or x.isdecimal() or x.isspace())}) - never
        return "".join(sorted(signs))


@lru_cache(4)
def load(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, p = model.normalizer_spec, SentencePieceProcessor(model_file=path)
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that keep texts as they are and put a space in front are supported")
    n = p.get_piece_size()
    texts = tuple(p.id_to_piece(i) for i in range(n))
    if any(SPACE in t.lstrip(SPACE) for t in texts):
        raise ValueError("pieces that cross a space are not supported")
    usable = tuple(not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(n))
    byte_ids = tuple(i for i in range(n) if p.is_byte(i))
    return Pieces(texts, tuple(p.get_score(i) for i in range(n)), usable, byte_ids, p.unk_id(), model.trainer_spec.model_type == 2)


def chunk_pattern(pieces: Pieces) -> str:
    """Runs of spaces with what follows up to the next space, line end or run of cutting signs."""
    signs = "".join(f"\\{c}" if c.isascii() else c for c in pieces.cut_signs())
    if not signs:
        return rf"{SPACE}*(?:[^{SPACE}\n]+|\n|$)"
    return rf"{SPACE}*(?:[^{SPACE}\n{signs}]+|[{signs}]+[^{SPACE}\n{signs}]*|\n|$)"


def _marked(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(pieces.texts[i], r, i) for i, r in pieces.rank().items()], "piece string, rank int, id int")


#: An edge is one long: rank, start, length and id from the top down, 24, 6, 6 and 24 bits.
ID_BITS, SPAN_BITS = 24, 12
NO_PIECE = (1 << ID_BITS) - 1


def lattice(chunks: DataFrame, pieces: Pieces) -> DataFrame:
    """(chunk, ..., edge) for every substring of a chunk that is a piece, and for every
    character that is none. Other columns of chunks are on the row of the first character
    alone, else null."""
    others = [c for c in chunks.columns if c not in ("chunk", "part")]
    keys = [c for c in chunks.columns if c in ("chunk", "part")]
    # what there is to explode depends on the length alone: 64 * start + length of each substring
    spans = [(n, [64 * i + k for i in range(n) for k in range(1, min(pieces.longest, n - i) + 1)]) for n in range(1, LONG + 1)]
    by_length = F.broadcast(chunks.sparkSession.createDataFrame(spans, "n int, spans array<int>"))
    subs = chunks.join(by_length, F.length("chunk") == F.col("n")).select(*keys, *others, F.explode("spans").alias("s"))
    subs = subs.withColumn("piece", F.expr("substring(chunk, shiftright(s, 6) + 1, s & 63)"))
    table = F.broadcast(piece_table(chunks.sparkSession, pieces))  # the model's vocabulary, whatever the corpus
    edges = subs.join(table, "piece", "left").where("rank IS NOT NULL OR (s & 63) = 1")
    edge = F.expr(f"shiftleft(shiftleft(cast(coalesce(rank, {NO_PIECE}) AS bigint), {SPAN_BITS}) | s, {ID_BITS}) | coalesce(id, {NO_PIECE})")
    return edges.select(*keys, *(F.when(F.col("s") == 1, F.col(c)).alias(c) for c in others), edge.alias("edge"))


_SPAN = f"cast(shiftright(e, {ID_BITS}) & 4095 AS int)"  # 64 * start + length
_START, _END = f"cast(shiftright(e, {ID_BITS + 6}) & 63 AS int)", f"cast((shiftright(e, {ID_BITS + 6}) & 63) + (shiftright(e, {ID_BITS}) & 63) AS int)"

#: Cuts as bits 0..n. An edge with cuts at its ends and one between is a merge; edges in order of rank, then start.
_MERGED = f"""aggregate(merges, shiftleft(1L, n + 1) - 1L, (b, e) -> if(bit_count(b & between[{_SPAN}]) = 1 AND (b & ends[{_SPAN}]) = ends[{_SPAN}], b & ~between[{_SPAN}], b))"""

#: Best (score, start of the last piece) for every end 1..n, then the cuts from the end back as bits.
_VITERBI = f"""aggregate(sequence(1, n), array(struct(0D AS s, 0 AS i)), (best, j) -> concat(best, array(array_max(transform(
  filter(edges, e -> {_END} = j),
  e -> struct(best[{_START}].s + coalesce(get(scores, cast(shiftright(e, {ID_BITS + SPAN_BITS}) AS int)), UNKNOWN) AS s, {_START} AS i))))),
  best -> aggregate(sequence(1, n), struct(shiftleft(1L, n) AS b, n AS at), (x, k) -> if(x.at = 0, x, struct(x.b | shiftleft(1L, best[x.at].i) AS b, best[x.at].i AS at))).b)"""


def folded(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(chunk, ..., ids) of chunks of up to LONG characters."""
    keys = [c for c in edges.columns if c in ("chunk", "part")]
    others = [c for c in edges.columns if c not in (*keys, "edge")]
    single = F.col("edge").bitwiseAND(F.lit(63 << ID_BITS)) == F.lit(1 << ID_BITS)  # one character: merges nothing
    lists = (F.collect_list(F.when(single, F.col("edge"))).alias("singles"), F.sort_array(F.collect_list(F.when(~single, F.col("edge")))).alias("merges"))
    by_chunk = edges.groupBy(*keys).agg(*lists, *(F.first(c, ignorenulls=True).alias(c) for c in others)).withColumn("n", F.length("chunk")).withColumn("edges", F.concat("singles", "merges"))
    # bit masks by 64 * start + length
    spans = [(i >> 6, i & 63) for i in range(64 * LONG)]
    for name, low in (("ends", 1), ("between", -2)):
        masks = [((1 << k) + low) << a if 0 < k <= LONG - a else 0 for a, k in spans]
        by_chunk = by_chunk.withColumn(name, F.expr(f"cast(split('{','.join(map(str, masks))}', ',') AS array<bigint>)"))
    fold = _MERGED
    if not pieces.bpe:
        by_chunk = by_chunk.withColumn("scores", F.lit([float(pieces.scores[i]) for i in pieces.rank()]))
        fold = _VITERBI.replace("UNKNOWN", f"{min(pieces.scores) - 10}D")
    # of an edge that is left: span and id
    left = f"sort_array(transform(filter(edges, e -> (b & ends[{_SPAN}]) = ends[{_SPAN}] AND (b & between[{_SPAN}]) = 0L), e -> e & {(1 << (ID_BITS + SPAN_BITS)) - 1}L))"
    cuts = by_chunk.withColumn("b", F.expr(fold)).withColumn("at", F.expr(left))
    first = pieces.byte_ids[0] if pieces.byte_ids else -1
    if pieces.byte_ids and pieces.byte_ids != tuple(range(first, first + 256)):
        raise ValueError("byte pieces must have ids in turn")
    byte = f"transform(sequence(0, octet_length(c) - 1), o -> {first} + cast(conv(substring(hex(encode(c, 'UTF-8')), 2 * o + 1, 2), 16, 10) AS int))" if pieces.byte_ids else f"array({pieces.unknown})"
    plain = f"transform(at, x -> cast(x & {NO_PIECE}L AS int))"
    # characters that no piece holds
    spelled = f"flatten(transform(at, x -> if((x & {NO_PIECE}L) = {NO_PIECE}L, flatten(transform(array(substring(chunk, cast(shiftright(x, {ID_BITS + 6}) AS int) + 1, 1)), c -> {byte})), array(cast(x & {NO_PIECE}L AS int)))))"
    ids = f"if(array_max(singles) >= {NO_PIECE << (ID_BITS + SPAN_BITS)}L, {spelled}, {plain})"
    return cuts.select(*keys, *others, F.expr(ids).alias("ids"))


def one_pass(chunk: str, rank: dict[str, int]) -> list[int]:
    """The cuts that `_MERGED` leaves."""
    cuts = set(range(len(chunk) + 1))
    spans = sorted((rank[chunk[a:z]], a, z) for a in range(len(chunk)) for z in range(a + 2, len(chunk) + 1) if chunk[a:z] in rank)
    for _, a, z in spans:
        inner = [c for c in range(a + 1, z) if c in cuts]
        if a in cuts and z in cuts and len(inner) == 1:
            cuts -= set(inner)
    return sorted(cuts)


@lru_cache(4)
def monotone(model: str) -> bool:
    """Whether merges in one pass by rank are those of the model. A merge that another of a
    higher rank makes possible would be missed; its span, alone, shows that too, as nothing
    had crossed its ends. So it is enough to try every piece by itself."""
    pieces = load(model)
    rank = {pieces.texts[i]: r for i, r in pieces.rank().items()}
    ids = {pieces.texts[i]: i for i in pieces.rank()}
    of_id = pieces.rank()
    for t in ids:
        if 2 < len(t) <= LONG and (len(one_pass(t, rank)) == 2) != (len(merged_by_heap(t, pieces, ids, of_id)) == 1):
            return False
    return True


def viterbi(chunk: str, pieces: Pieces, ids: dict[str, int], rank: dict[int, int] | None = None) -> list[int]:
    """The best path through one chunk, in steps linear in its length."""
    worst, best = min(pieces.scores) - 10, [(0.0, 0)]
    for j in range(1, len(chunk) + 1):
        ways = [(best[i][0] + (pieces.scores[k] if (k := ids.get(chunk[i:j])) is not None else worst), i) for i in range(max(0, j - pieces.longest), j) if i == j - 1 or chunk[i:j] in ids]
        best.append(max(ways))
    out, j = [], len(chunk)
    while j:
        i = best[j][1]
        part = chunk[i:j]
        out.append([ids[part]] if part in ids else [pieces.byte_ids[b] for b in part.encode()] if pieces.byte_ids else [pieces.unknown])
        j = i
    return [k for part in reversed(out) for k in part]


def merged_by_heap(chunk: str, pieces: Pieces, ids: dict[str, int], rank: dict[int, int]) -> list[int]:
    """The merges of one long chunk in order of rank, leftmost first, with a heap."""
    n = len(chunk)
    nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = nxt[a]
        if b < n and (i := ids.get(chunk[a : end[b]])) is not None and end[b] - a <= pieces.longest:
            heapq.heappush(heap, (rank[i], a, end[b]))

    for a in range(n - 1):
        offer(a)
    dead = [False] * n
    while heap:
        _, a, stop = heapq.heappop(heap)
        if dead[a] or nxt[a] >= n or end[nxt[a]] != stop:
            continue
        b = nxt[a]
        dead[b], end[a], nxt[a] = True, stop, nxt[b]
        if nxt[b] < n:
            prev[nxt[b]] = a
        offer(a)
        if prev[a] >= 0:
            offer(prev[a])
    out, a = [], 0
    while a < n:
        part = chunk[a : end[a]]
        if part in ids:
            out.append(ids[part])
        else:
            out += [pieces.byte_ids[b] for b in part.encode()] if pieces.byte_ids else [pieces.unknown]
        a = nxt[a]
    return out


def alone(model_path: str):
    """chunk -> ids in Python, as the model's kind means it."""
    pieces = load(model_path)
    rank = pieces.rank()
    ids = {pieces.texts[i]: i for i in rank}
    fold = merged_by_heap if pieces.bpe else viterbi
    return lambda chunk: fold(chunk, pieces, ids, rank)


def chunk_ids(chunks: DataFrame, model_path: str) -> DataFrame:
    """(chunk, ..., ids) for rows of distinct chunks of up to LONG characters."""
    pieces = load(model_path)
    return folded(lattice(chunks, pieces), pieces)


def _split_key() -> list[Column]:
    return [F.xxhash64(F.input_file_name()).alias("_file"), F.input_file_block_start().alias("_start")]


WORD = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _cut(text: str) -> list[str]:
    """The words of a text, each with the spaces before it; where that is one space each (a
    plain text), without it."""
    if SPACE not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    return WORD.findall(SPACE + text.replace(" ", SPACE))


def _spaced(word: str) -> str:
    return word if word.startswith(SPACE) else SPACE + word


def dictionary(docs: DataFrame, model_path: str, text_col: str) -> str:
    """Writes, for every split of the files under docs, the ids of the chunks that it holds;
    returns the folder."""
    spark, pattern = docs.sparkSession, chunk_pattern(load(model_path))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, got = re.compile(pattern), None, set()

        def flushed() -> Iterator[pa.RecordBatch]:
            # letters alone are one chunk
            chunks = {SPACE + w for w in got if w.isalpha()}
            chunks.update(c for w in got if not w.isalpha() for c in split.findall(_spaced(w)))
            got.clear()
            rows = [c for c in chunks if 0 < len(c) <= LONG]
            for a in range(0, len(rows), 65536):
                part = rows[a : a + 65536]
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(part), pa.int64()) for x in place), pa.array(part, pa.string())], ["_file", "_start", "chunk"])

        for batch in batches:
            for text, file, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if place != (file, start) or len(got) > GATHERED:
                    if got:
                        yield from flushed()
                    place = (file, start)
                if t := text.as_py():
                    got.update(_cut(t))
        if got:
            yield from flushed()
        give_back()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), *_split_key()).mapInArrow(found, "_file long, _start long, chunk string")
    # a row of a chunk has the places of some files only, however many files there are
    parts = max(1, len(docs.inputFiles()) // FILES)
    rows = rows.withColumn("part", F.pmod("_file", F.lit(parts)).cast("int"))
    chunks = rows.groupBy("chunk", "part").agg(F.collect_set(F.struct("_file", "_start")).alias("places"))
    path = new_path(spark, "chunk-ids")
    out = chunk_ids(chunks, model_path).select("chunk", "ids", F.explode("places").alias("place")).select("chunk", "ids", "place._file", "place._start")
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    was = spark.conf.get(setting)
    spark.conf.set(setting, str(GROUPS))
    try:
        out.repartition("_file", "_start").write.partitionBy("_file", "_start").parquet(path)
    finally:
        spark.conf.set(setting, was)
    release(spark)
    return path


class ChunkIds(dict):
    """Word (text between spaces, with its spaces) -> ids as bytes, from one split's chunks."""

    def __init__(self, folder: str, file: int, start: int, pattern: re.Pattern, alone):
        uri = urlparse(folder)
        fs, root = (pafs.LocalFileSystem(), uri.path) if uri.scheme in ("", "file") else pafs.FileSystem.from_uri(folder)
        own = f"{root}/_file={file}"
        if fs.get_file_info(f"{own}/_start={start}").type != pafs.FileType.NotFound:
            own = f"{own}/_start={start}"  # else the file was split in other places: all its chunks
        self.chunks: dict[str, bytes] = {}
        self.pattern, self.alone = pattern, alone
        if fs.get_file_info(own).type == pafs.FileType.NotFound:
            return
        for info in fs.get_file_info(pafs.FileSelector(own, recursive=True)):
            if info.base_name.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(65536, columns=["chunk", "ids"]):
                        ids = batch.column(1)
                        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
                        for c, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:]):
                            self.chunks[c] = flat[a:b].tobytes()

    def __missing__(self, key: str) -> bytes:
        if (out := self.chunks.get(word := _spaced(key))) is None:  # else the word is one chunk
            out = b"".join(self.chunks.get(c) or np.array(self.alone(c), "<u4").tobytes() for c in self.pattern.findall(word) if c)
        if len(self) < 100_000:
            self[key] = out
        return out


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is a table of files with at most filters and projections over it."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return node.children().isEmpty() and bool(docs.inputFiles())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) for every row; decoded: also the text that the ids decode to,
    in the same pass, which spares a second Python worker for each task. docs is a table of files, read with at most
    filters and projections; anything else is written to the shared folder first."""
    if not _is_scan(docs):
        docs, _ = written(docs.select(id_col, text_col), "texts")
    pieces, pattern, names = load(model_path), chunk_pattern(load(model_path)), ["doc_id", "ids", "text"][: 2 + decoded]
    # without a dictionary every chunk is encoded by itself
    folder = dictionary(docs, model_path, text_col) if not pieces.bpe or monotone(model_path) else new_path(docs.sparkSession, "chunk-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, single = re.compile(pattern), None, alone(model_path)
        back = texts_of(load(model_path)) if decoded else None
        for batch in (whole.slice(k, SOME) for whole in batches for k in range(0, whole.num_rows, SOME)):
            parts = []
            for text, file, start in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                t = text.as_py()
                if not t:
                    parts.append(b"")
                    continue
                if place != (file, start):
                    known = None  # the last split's ids go before the next one's come
                    place, known = (file, start), ChunkIds(folder, file, start, split, single)
                cut = _cut(t)
                parts.append(b"".join(map(known.__getitem__, cut)))
            offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4))).astype(np.int32)
            ids = np.frombuffer(b"".join(parts), "<u4").view(np.int32)
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            if back:
                out.append(back(ids, offsets))
            yield pa.RecordBatch.from_arrays(out, names)
            parts = ids = out = batch = None
        known = None
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *_split_key()).mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def _shown(pieces: Pieces) -> list[bytes]:
    byte = {i: bytes([k]) for k, i in enumerate(pieces.byte_ids)}
    return [byte.get(i) or (t.replace(SPACE, " ").encode() if pieces.usable[i] else b"") for i, t in enumerate(pieces.texts)]


def texts_of(pieces: Pieces):
    """(ids of many texts in turn, where each begins and the last ends) -> the texts. For ids
    of whole texts: their bytes are UTF-8."""
    table = pa.array(_shown(pieces), pa.large_binary())

    def back(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        # the taken pieces lie one behind the other: the texts need only other ends
        taken = table.take(pa.array(ids))
        _, ends, data = taken.buffers()
        at = np.frombuffer(ends, np.int64, len(taken) + 1)[offsets] if len(taken) else np.zeros(len(offsets), np.int64)
        whole = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at), data or pa.py_buffer(b""))
        return pc.utf8_slice_codeunits(whole, 1).cast(pa.string())

    return back


def decoder(pieces: Pieces):
    """ids -> text."""
    shown = _shown(pieces)
    return lambda ids: b"".join(map(shown.__getitem__, ids)).decode("utf-8", "replace")[1:]


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(load(model_path))
        for batch in batches:
            ids = batch.column(1)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            texts = [back(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
            texts = ids = flat = batch = None
        give_back()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
