"""Token ids packed into fixed rows by best-fit decreasing.

Documents become token ids with an end mark.  A document longer than a row is
split into consecutive pieces, none of its ids lost.  The pieces of a block of
bounded size are taken by falling length, and each goes to the open row with
the least room that still holds it; a segment tree over the room left finds
that row.  A packed row has its ids as a little-endian matrix row padded to the
row length, the cumulative segment lengths, the places where positions restart
at zero, and the document and token offset of every segment.

Every task packs what it reads, without a shuffle; rows keep to the tasks'
blocks, so a block's last row may have room left.

Defined cases: a null or empty text is its end mark alone; a null ``doc_id``
stays null in the lists; bytes that are no UTF-8 are read as U+FFFD; texts of
any length are taken whole; pieces of equal length keep their order, and of
rows with equal room the latest opened is filled; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import read_ranks, read_vocabulary, text_runs
from .scratch import small_batches

ROW_LENGTH, BLOCK_TOKENS, PART_CHARS = 2048, 1 << 21, 1 << 18
SCHEMA = (
    "pack_id long, n_tokens int, ids binary, cumulative_lengths array<int>, position_resets array<int>, "
    "doc_ids array<long>, doc_offsets array<long>"
)
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _parts(text: str) -> Iterator[str]:
    """A text cut before single spaces, which no token crosses."""
    at = 0
    while len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Tokenizer:
    """Ids of texts with the end mark, the first id that is free."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=read_ranks(content), special_tokens={})
        self.end = self.encoding.n_vocab
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        ids = [i for part in _parts(text) for i in self.encoding.encode_ordinary(part)]
        return np.array([*ids, self.end], self.kind)


class _Room:
    """A segment tree over the room left in open rows: the least that suffices."""

    def __init__(self, length: int) -> None:
        self.width = 1 << length.bit_length()
        self.counts = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.width + room
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row that has room for ``need``."""
        node = self.width + need
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.width
        while node:
            self.counts[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers by best-fit decreasing; no size is over ``length``."""
    room, rows = _Room(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[piece])
        if found is None:
            rows.append([])
            found = (length, len(rows) - 1)
        rows[found[1]].append(piece)
        if found[0] > sizes[piece]:
            room.put(found[0] - sizes[piece], found[1])
    return rows


def _pack_block(pieces: list[tuple[int | None, int, np.ndarray]], length: int, first_id: int) -> pa.RecordBatch:
    """A batch of packed rows of (doc_id, offset, ids) pieces."""
    rows = best_fit([len(ids) for *_, ids in pieces], length)
    columns: list[list] = [[] for _ in range(7)]
    for number, row in enumerate(rows):
        parts = [pieces[i] for i in row]
        ends = np.cumsum([len(ids) for *_, ids in parts]).tolist()
        matrix = np.zeros(length, parts[0][2].dtype)
        matrix[: ends[-1]] = np.concatenate([ids for *_, ids in parts])
        values = (first_id + number, ends[-1], matrix.tobytes(), [0, *ends], [0, *ends[:-1]], [d for d, *_ in parts], [o for _, o, _ in parts])
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_TOKENIZERS: dict[tuple[int, str], Tokenizer] = {}


def _packing(vocabulary, pattern: str, length: int) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        content = vocabulary.value
        key = (hash(content), pattern)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = Tokenizer(content, pattern)
        held, size, next_id = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in text_runs(batch, 1):
                for doc_id, ids in zip(part.column(0).to_pylist(), map(_TOKENIZERS[key].encode, texts), strict=True):
                    held += [(doc_id, at, ids[at : at + length]) for at in range(0, len(ids), length)]
                    size += len(ids)
                if size >= BLOCK_TOKENS:
                    out = _pack_block(held, length, next_id)
                    yield out
                    held, size, next_id = [], 0, next_id + out.num_rows
        if held:
            yield _pack_block(held, length, next_id)

    return run


def pack(docs: DataFrame, path: str, pattern: str, length: int = ROW_LENGTH) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text) under :data:`SCHEMA`."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(spark, path))
    table = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return table.mapInArrow(_packing(vocabulary, pattern, length), SCHEMA)


def segment_bytes(packed: DataFrame, path: str) -> DataFrame:
    """(doc_id, doc_offset, bytes) of the segments of packed rows, end marks left out."""
    vocabulary = packed.sparkSession.sparkContext.broadcast(read_vocabulary(packed.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(vocabulary.value)
        tokens = {rank: token for token, rank in ranks.items()}
        kind = np.dtype("<u2" if max(tokens) + 1 < 1 << 16 else "<u4")
        for batch in batches:
            for ids, ends, docs, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = np.frombuffer(ids, kind)
                made = [b"".join(tokens.get(i, b"") for i in row[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "doc_offset", "bytes"])

    return packed.select("ids", "cumulative_lengths", "doc_ids", "doc_offsets").mapInArrow(run, "doc_id long, doc_offset long, bytes binary")


def _writing(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}"
        rows, attempt = 0, uuid.uuid4().hex
        endings = {"ids.bin": "ids", "cumulative_lengths.bin": "cumulative_lengths", "position_resets.bin": "position_resets", "segments.bin": "cumulative_lengths"}
        files = {e: store.open_output_stream(f"{name}.{e}.{attempt}") for e in endings}
        for batch in batches:
            for row in batch.to_pylist():
                rows += 1
                files["ids.bin"].write(row["ids"])
                files["segments.bin"].write(np.array([len(row["position_resets"])], "<i4").tobytes())
                for e in ("cumulative_lengths.bin", "position_resets.bin"):
                    files[e].write(np.array(row[endings[e]], "<i4").tobytes())
        for e, file in files.items():
            file.close()
            store.move(f"{name}.{e}.{attempt}", f"{name}.{e}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.ids.bin"]), pa.array([rows], pa.int64())], ["file", "rows"])

    return run


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Write packed rows below the URI ``folder``; (file, rows) of each part.

    A part has its id matrix in ``ids.bin``, the segments of each row in
    ``segments.bin``, and by these the int32 ``cumulative_lengths.bin`` and
    ``position_resets.bin``.  A part gets its name when it is complete, so a
    repeated task replaces it.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    return packed.mapInArrow(_writing(folder), "file string, rows long")
