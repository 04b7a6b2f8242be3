"""Byte codes: variable-length integers, run lengths, compression.

Decoders check every length against what is there before they use it and
raise :class:`ValueError` on anything else.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable

import numpy as np

#: The kinds of a byte run.
RUN_ZERO, RUN_255, RUN_BYTE, LITERAL = 0, 1, 2, 3


def varint_size(value: int, tag_bits: int = 0) -> int:
    """Bytes of a big-endian base-128 integer with tag bits on top."""
    value, most, size = int(value), (1 << (7 - tag_bits)) - 1, 1
    while value > most:
        value >>= 7
        size += 1
    return size


def pack_varint(value: int, tag: int = 0, tag_bits: int = 0) -> bytes:
    value = int(value)
    if value < 0 or tag >> tag_bits:
        raise ValueError("value or tag out of range")
    size = varint_size(value, tag_bits)
    groups = [(value >> (7 * k)) & 127 for k in range(size - 1)]
    head = (value >> (7 * (size - 1))) | tag << (8 - tag_bits) | ((size > 1) << (7 - tag_bits))
    return bytes([head, *(g | 128 * (k > 0) for k, g in reversed(list(enumerate(groups))))])


class Reader:
    """Reads integers and byte parts from the front of some bytes."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, size: int) -> bytes:
        if size < 0 or size > self.left():
            raise ValueError("data ends early")
        self.at += size
        return self.data[self.at - size : self.at]

    def rest(self) -> bytes:
        return self.take(self.left())

    def tagged(self, tag_bits: int) -> tuple[int, int]:
        """(tag, value) of the next integer; more than 64 bits are refused."""
        byte = self.take(1)[0]
        tag, value = byte >> (8 - tag_bits), byte & ((1 << (7 - tag_bits)) - 1)
        more = byte >> (7 - tag_bits) & 1
        while more:
            byte = self.take(1)[0]
            value, more = value << 7 | byte & 127, byte >> 7
            if value >> 64:
                raise ValueError("integer of more than 64 bits")
        return tag, value

    def varint(self) -> int:
        return self.tagged(0)[1]

    def until(self, mark: bytes, most: int = 260) -> bytes:
        end = self.data.find(mark, self.at, self.at + most)
        if end < 0:
            raise ValueError("text without its end")
        out = self.data[self.at : end]
        self.at = end + len(mark)
        return out

    def end(self) -> None:
        if self.left():
            raise ValueError("data behind the end")


def runs(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, length) of the maximal runs of equal bytes."""
    if not len(data):
        return []
    cut = np.flatnonzero(np.r_[True, data[1:] != data[:-1]])
    return list(zip(data[cut].tolist(), cut.tolist(), np.diff(np.r_[cut, len(data)]).tolist(), strict=True))


def byte_runs(data: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """(kind, begin, length) tiles: runs of 0 or 255, runs of another byte of
    ``least`` or more, and what lies between as literals."""
    out: list[tuple[int, int, int]] = []
    for value, begin, length in runs(data):
        if value == 0 and length >= 2:
            kind = RUN_ZERO
        elif value == 255 and length >= 2:
            kind = RUN_255
        elif length >= least:
            kind = RUN_BYTE
        else:
            kind = LITERAL
        if kind == LITERAL and out and out[-1][0] == LITERAL:
            out[-1] = (LITERAL, out[-1][1], out[-1][2] + length)
        else:
            out.append((kind, begin, length))
    return out


def pack_runs(data: np.ndarray) -> tuple[bytes, bytes]:
    """(control, code) of a byte run coding: each control has its kind in two
    bits and the length less one; code has one byte of a run, all of a literal."""
    control, code = [], []
    for kind, begin, length in byte_runs(data):
        control.append(pack_varint(length - 1, kind, 2))
        if kind >= RUN_BYTE:
            code.append(data[begin : begin + (1 if kind == RUN_BYTE else length)].tobytes())
    return b"".join(control), b"".join(code)


def unpack_runs(control: bytes, code: bytes, size: int) -> np.ndarray:
    control_reader, code_reader, out, made = Reader(control), Reader(code), [], 0
    while control_reader.left():
        kind, length = control_reader.tagged(2)
        length += 1
        made += length
        if made > size:
            raise ValueError("runs exceed their size")
        if kind == LITERAL:
            out.append(np.frombuffer(code_reader.take(length), np.uint8))
        else:
            value = code_reader.take(1)[0] if kind == RUN_BYTE else 255 * (kind == RUN_255)
            out.append(np.full(length, value, np.uint8))
    code_reader.end()
    if made != size:
        raise ValueError("runs fall short of their size")
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def zero_run_sizes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alternating lengths of zeros and of others that tile ``data``; zeros come first."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = data != 0
    sizes = np.diff(np.r_[0, np.flatnonzero(other[1:] != other[:-1]) + 1, len(data)])
    sizes = np.r_[[0] * int(other[0]), sizes].astype(np.int64)
    sizes = np.r_[sizes, [0] * (len(sizes) % 2)].astype(np.int64)
    return sizes[::2], sizes[1::2]


def zero_runs(data: np.ndarray) -> list[tuple[int, int]]:
    """:func:`zero_run_sizes` as pairs."""
    return list(zip(*(v.tolist() for v in zero_run_sizes(data)), strict=True))


def pack_zero_runs(data: np.ndarray) -> bytes:
    out, at = [], 0
    for zeros, others in zero_runs(data):
        at += zeros
        out += [pack_varint(zeros), pack_varint(others), data[at : at + others].tobytes()]
        at += others
    return b"".join(out)


def unpack_zero_runs(data: bytes, size: int) -> np.ndarray:
    reader, out, at = Reader(data), np.zeros(size, np.uint8), 0
    while reader.left():
        at += reader.varint()
        n = reader.varint()
        if at + n > size:
            raise ValueError("runs exceed their size")
        out[at : at + n] = np.frombuffer(reader.take(n), np.uint8)
        at += n
    if at > size:
        raise ValueError("runs exceed their size")
    return out


def pack_signed(value: int) -> bytes:
    """A varint with the sign in its top bit."""
    return pack_varint(abs(value), int(value < 0), 1)


def read_signed(reader: Reader) -> int:
    sign, value = reader.tagged(1)
    return -value if sign else value


#: Compressors and decompressors by tag, with the aliases of a tag.
COMPRESS: dict[str, Callable[[bytes], bytes]] = {
    "": bytes,
    "zlib": lambda data: zlib.compress(data, 9),
    "ldef": lambda data: zlib.compress(data, 6),
    "bz2": lambda data: bz2.compress(data, 9),
    "lzma": lambda data: lzma.compress(data, lzma.FORMAT_ALONE, preset=6),
    "lzma2": lambda data: lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6}]),
    "7zXZ": lambda data: lzma.compress(data, lzma.FORMAT_XZ, preset=6),
}
ALIASES = {"pzlib": "zlib", "pldef": "ldef", "pbz2": "bz2", "bzip2": "bz2", "pbzip2": "bz2"}


def _bounded(make: Callable, data: bytes, size: int) -> bytes:
    out = make().decompress(data, min(size, 1 << 40) + 1)
    if len(out) != size:
        raise ValueError("decompressed data has another size")
    return out


def _inflate(data: bytes, size: int) -> bytes:
    return _bounded(zlib.decompressobj, data, size)


DECOMPRESS: dict[str, Callable[[bytes, int], bytes]] = {
    "": lambda data, size: data,
    "zlib": _inflate,
    "ldef": _inflate,
    "bz2": lambda data, size: _bounded(bz2.BZ2Decompressor, data, size),
    "lzma": lambda data, size: _bounded(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), data, size),
    "lzma2": lambda data, size: _bounded(lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6}]), data, size),
    "7zXZ": lambda data, size: _bounded(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), data, size),
}

try:
    import zstandard
except ImportError:
    zstandard = None
if zstandard is not None:
    COMPRESS["zstd"] = lambda data: zstandard.ZstdCompressor(level=19).compress(data)

    def _zstd(data: bytes, size: int) -> bytes:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size + 1)
        if len(out) != size:
            raise ValueError("decompressed data has another size")
        return out

    DECOMPRESS["zstd"] = _zstd


def compress(tag: str, data: bytes) -> bytes:
    tag = ALIASES.get(tag, tag)
    if tag not in COMPRESS:
        raise ValueError(f"no compressor {tag!r}")
    return COMPRESS[tag](data)


def decompress(tag: str, data: bytes, size: int) -> bytes:
    tag = ALIASES.get(tag, tag)
    if tag not in DECOMPRESS:
        raise ValueError(f"no decompressor {tag!r}")
    try:
        return DECOMPRESS[tag](data, size)
    except ValueError:
        raise
    except Exception as error:
        raise ValueError(f"bad {tag} data") from error


def compress_with_dictionary(data: bytes, before: bytes) -> bytes:
    """A block deflated with the bytes before it as dictionary."""
    packer = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=before[-32768:]) if before else zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def decompress_with_dictionary(data: bytes, before: bytes, size: int) -> bytes:
    unpacker = zlib.decompressobj(-15, zdict=before[-32768:]) if before else zlib.decompressobj(-15)
    out = unpacker.decompress(data, size + 1)
    if len(out) != size:
        raise ValueError("decompressed block has another size")
    return out
