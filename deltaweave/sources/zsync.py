"""The zsync control file (version 0.6.2): write, read, match, rebuild.

A text head, a blank line, and for every block the last bytes of its rolling
sum and the first bytes of its MD4 digest, blocks padded with zero bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checksums import rolling
from ..functions.kernels import as_array, hash_hits
from ..operators.tables import parts

VERSION = "0.6.2"


def _md4_rounds(state: tuple[int, int, int, int], block: bytes) -> tuple[int, int, int, int]:
    """One block of MD4 as RFC 1320 describes it."""
    x, mask = struct.unpack("<16I", block), 0xFFFFFFFF
    v = list(state)
    rounds = (
        (lambda b, c, d: b & c | ~b & d, 0, range(16), (3, 7, 11, 19)),
        (lambda b, c, d: b & c | b & d | c & d, 0x5A827999, [4 * (i % 4) + i // 4 for i in range(16)], (3, 5, 9, 13)),
        (lambda b, c, d: b ^ c ^ d, 0x6ED9EBA1, [int(f"{i:04b}"[::-1], 2) for i in range(16)], (3, 9, 11, 15)),
    )
    for mix, constant, order, shifts in rounds:
        for step, k in enumerate(order):
            a, b, c, d = (v[(n - step) % 4] for n in range(4))
            total = (a + (mix(b, c, d) & mask) + x[k] + constant) & mask
            turn = shifts[step % 4]
            v[-step % 4] = (total << turn | total >> (32 - turn)) & mask
    return tuple((s + n) & mask for s, n in zip(state, v, strict=True))


def md4(data: bytes) -> bytes:
    if "md4" in hashlib.algorithms_available:
        try:
            return hashlib.new("md4", data).digest()
        except ValueError:
            pass
    state = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    filled = data + b"\x80" + b"\0" * (-(len(data) + 9) % 64) + struct.pack("<Q", 8 * len(data))
    for at in range(0, len(filled), 64):
        state = _md4_rounds(state, filled[at : at + 64])
    return struct.pack("<4I", *state)


def md4_rows(rows: np.ndarray) -> np.ndarray:
    """The MD4 digests of the rows of an array of bytes, all rows at once."""
    count, size = rows.shape
    tail = b"\x80" + b"\0" * (-(size + 9) % 64) + struct.pack("<Q", 8 * size)
    words = np.ascontiguousarray(np.concatenate([rows, np.broadcast_to(as_array(tail), (count, len(tail)))], axis=1)).view("<u4").T.copy()
    state = [np.full(count, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    rounds = (
        (lambda b, c, d: (c ^ d) & b ^ d, 0, range(16), (3, 7, 11, 19)),
        (lambda b, c, d: (b | c) & d | b & c, 0x5A827999, [4 * (i % 4) + i // 4 for i in range(16)], (3, 5, 9, 13)),
        (lambda b, c, d: b ^ c ^ d, 0x6ED9EBA1, [int(f"{i:04b}"[::-1], 2) for i in range(16)], (3, 9, 11, 15)),
    )
    for at in range(0, len(words), 16):
        v = list(state)
        for mix, constant, order, shifts in rounds:
            for step, k in enumerate(order):
                a, b, c, d = (v[(n - step) % 4] for n in range(4))
                total = mix(b, c, d) + a
                total += words[at + k]
                total += np.uint32(constant)
                turn = np.uint32(shifts[step % 4])
                v[-step % 4] = total << turn | total >> np.uint32(32 - turn)
        state = [s + n for s, n in zip(state, v, strict=True)]
    return np.stack(state, axis=1).astype("<u4").view(np.uint8).reshape(count, 16)


@dataclass(frozen=True)
class Control:
    """A control file: block size, length, digests of every block."""

    name: str
    block_size: int
    length: int
    sequence: int
    rolling: list[bytes]
    strong: list[bytes]
    sha1: str


def _blocks(data: bytes, size: int) -> np.ndarray:
    """The blocks of a stream as rows, the last one padded with zero bytes."""
    return as_array(data + b"\0" * (-len(data) % size)).reshape(-1, size)


def make_controls(contents: list[bytes], size: int = 2048, name: str = "", rolling_bytes: int = 4, strong_bytes: int = 16, sequence: int = 2) -> list[bytes]:
    """The control files of several streams; their blocks are digested together."""
    cut = [_blocks(data, size) for data in contents]
    rows = np.concatenate(cut) if cut else np.zeros((0, size), np.uint8)
    values = rows.astype(np.uint64)
    sums = np.stack([values.sum(1), (values * np.arange(size, 0, -1, dtype=np.uint64)).sum(1)], axis=1).astype(np.uint16).astype(">u2")
    body = np.concatenate([sums.view(np.uint8).reshape(-1, 4)[:, 4 - rolling_bytes :], md4_rows(rows)[:, :strong_bytes]], axis=1)
    out, at = [], 0
    for data, part in zip(contents, cut, strict=True):
        head = [("zsync", VERSION), ("Filename", name), ("Blocksize", size), ("Length", len(data)), ("Hash-Lengths", f"{sequence},{rolling_bytes},{strong_bytes}"), ("SHA-1", hashlib.sha1(data).hexdigest())]
        out.append("".join(f"{k}: {v}\n" for k, v in head).encode() + b"\n" + body[at : at + len(part)].tobytes())
        at += len(part)
    return out


def make_control(data: bytes, size: int = 2048, name: str = "", rolling_bytes: int = 4, strong_bytes: int = 16, sequence: int = 2) -> bytes:
    return make_controls([data], size, name, rolling_bytes, strong_bytes, sequence)[0]


def read_control(raw: bytes) -> Control:
    head, mark, body = raw.partition(b"\n\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\n") if ": " in line)
    try:
        size, length = int(fields["Blocksize"]), int(fields["Length"])
        sequence, rolling_bytes, strong_bytes = map(int, fields["Hash-Lengths"].split(","))
    except (KeyError, ValueError) as error:
        raise ValueError("not a control file") from error
    width, count = rolling_bytes + strong_bytes, -(-length // size) if size > 0 else -1
    if not mark or not fields.get("zsync") or count < 0 or not 1 <= rolling_bytes <= 4 or not 3 <= strong_bytes <= 16 or len(body) != count * width:
        raise ValueError("not a control file, or a damaged one")
    parts = [body[i * width : (i + 1) * width] for i in range(count)]
    return Control(fields.get("Filename", ""), size, length, sequence, [p[:rolling_bytes] for p in parts], [p[rolling_bytes:] for p in parts], fields.get("SHA-1", ""))


def _candidates(control: Control, data: np.ndarray, old_size: int) -> Iterator[tuple[int, Iterator[int]]]:
    """Each block and the places in old, in order, whose sums are its own and, with
    a sequence of two, whose next block's sums are the next one's."""
    size, width = control.block_size, len(control.rolling[0])
    a, s = rolling(data, size, 16, None, 0)
    sums = ((a << np.uint64(16) | s) & np.uint64((1 << 8 * width) - 1))[:old_size]
    wanted = np.array([int.from_bytes(r, "big") for r in control.rolling], np.uint64)
    table, group = np.unique(wanted, return_inverse=True)
    shift = np.uint64(64 - 8 * width)
    at, place = hash_hits(sums << shift, table << shift)
    order = np.argsort(place, kind="stable")
    at, bounds = at[order], np.searchsorted(place[order], np.arange(len(table) + 1))
    for i, g in enumerate(group.tolist()):
        found = at[bounds[g] : bounds[g + 1]]
        if control.sequence > 1 and i + 1 < len(wanted) and len(found):
            behind = np.minimum(found + size, len(sums) - 1)
            found = found[(found + size >= len(sums)) | (sums[behind] == wanted[i + 1])]
        if len(found):
            yield i, iter(found.tolist())


def locate_each(controls: list[Control], olds: list[bytes]) -> list[list[int]]:
    """The first place in old of every block, or -1, for several streams.

    A block counts where its sums match and, with a sequence of two, where the
    next block's do behind it; the strong digest decides.  The end of old is
    padded with zero bytes like the last block.  Candidates of all blocks are
    digested together, then the next ones of those that have not matched.
    """
    out = [[-1] * len(control.rolling) for control in controls]
    padded = [as_array(old + b"\0" * (2 * control.block_size - 1)) for control, old in zip(controls, olds, strict=True)]
    waiting = []
    for k, (control, old) in enumerate(zip(controls, olds, strict=True)):
        if control.rolling and old:
            waiting += [(k, i, places) for i, places in _candidates(control, padded[k], len(old))]
    while waiting:
        again = []
        for begin in range(0, len(waiting), 1 << 14):
            tried = [(k, i, places, at) for k, i, places in waiting[begin : begin + (1 << 14)] if (at := next(places, -1)) >= 0]
            for size in {controls[k].block_size for k, *_ in tried}:
                mine = [t for t in tried if controls[t[0]].block_size == size]
                digests = md4_rows(np.stack([padded[k][at : at + size] for k, _, _, at in mine]))
                for (k, i, places, at), digest in zip(mine, digests, strict=True):
                    strong = controls[k].strong[i]
                    if digest[: len(strong)].tobytes() == strong:
                        out[k][i] = at
                    else:
                        again.append((k, i, places))
        waiting = again
    return out


def locate(control: Control, old: bytes) -> list[int]:
    """The first place in old of every block of one stream, or -1."""
    return locate_each([control], [old])[0]


def rebuild(control: Control, old: bytes, places: list[int], fetched: dict[int, bytes]) -> bytes:
    """New bytes from old ones and fetched blocks; the whole digest must match."""
    size = control.block_size
    padded = old + b"\0" * 2 * size
    parts = [padded[at : at + size] if at >= 0 else fetched[i].ljust(size, b"\0") for i, at in enumerate(places)]
    made = b"".join(parts)[: control.length]
    if control.sha1 and hashlib.sha1(made).hexdigest() != control.sha1:
        raise ValueError("the rebuilt data has another digest")
    return made


def control_files(streams: DataFrame, size: int = 2048) -> DataFrame:
    """(stream_id, control) of each stream (stream_id, content)."""
    from pyspark.sql.types import BinaryType

    def run(values: pa.Array) -> pa.Array:
        made: list[bytes] = []
        for part in parts(pa.RecordBatch.from_arrays([values], ["content"])):
            made += make_controls([v.as_py() or b"" for v in part.column(0)], size)
        return pa.array(made, pa.binary())

    return streams.select("stream_id", F.arrow_udf(run, BinaryType())("content").alias("control"))


def synchronise(old: DataFrame, new: DataFrame, size: int = 2048) -> DataFrame:
    """(stream_id, blocks, need_blocks, ok): new rebuilt by control file, old and
    the blocks that old lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            before, after, raw = ([v.as_py() or b"" for v in part.column(c)] for c in ("old", "new", "control"))
            controls = [read_control(r) for r in raw]
            counts, needs, fine = [], [], []
            for control, places, o, n in zip(controls, locate_each(controls, before), before, after, strict=True):
                missing = {i: n[i * size : (i + 1) * size] for i, at in enumerate(places) if at < 0}
                counts.append(len(places))
                needs.append(len(missing))
                fine.append(rebuild(control, o, places, missing) == n)
            yield pa.RecordBatch.from_arrays([part.column("stream_id"), pa.array(counts, pa.int64()), pa.array(needs, pa.int64()), pa.array(fine, pa.bool_())], ["stream_id", "blocks", "need_blocks", "ok"])

    both = old.select("stream_id", F.col("content").alias("old")).join(new.select("stream_id", F.col("content").alias("new")), "stream_id")
    kind = new.schema["stream_id"].dataType.simpleString()
    return both.join(control_files(new, size), "stream_id").select("stream_id", "old", "new", "control").mapInArrow(run, f"stream_id {kind}, blocks long, need_blocks long, ok boolean")
