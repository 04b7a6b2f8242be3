"""Patch containers: encoders and checking decoders for one pair of streams.

Each container holds covers, the literal bytes between them, and the byte
difference ``new - old`` of every cover.  The layouts follow the published
descriptions of such formats; tags are parameters with values of our own, as
no byte-level parity is claimed.  bsdiff 4 and VCDIFF (RFC 3284) are public
formats and keep their own tags.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from .codecs import (
    Reader,
    compress,
    decompress,
    pack_runs,
    pack_signed,
    pack_varint,
    pack_zero_runs,
    read_signed,
    unpack_runs,
    unpack_zero_runs,
)
from .kernels import Cover, apply_covers, as_array, check_covers, literals, steps_of

SECTIONS_TAG, STEPS_TAG, LITE_TAG = b"DWSEC1", b"DWSTEP1", b"dl"
STEP_BYTES, STEP_LIMIT = 256 << 10, 16 << 20


@dataclass(frozen=True)
class DiffInfo:
    """The head of a container."""

    kind: str
    compress: str
    old_size: int
    new_size: int
    covers: int
    step_bytes: int = 0


def _differences(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> list[bytes]:
    return [(new[j : j + n] - old[i : i + n]).tobytes() for i, j, n in covers]


def _checked(covers: list[Cover], old: np.ndarray, new: np.ndarray) -> None:
    if not check_covers(covers, len(old), len(new)):
        raise ValueError("covers are not in order or out of bounds")


def _cover_codes(covers: list[Cover], from_end: bool) -> list[tuple[bytes, bytes, bytes]]:
    """(old delta, new gap, length) codes; old counts from the last cover's end
    or from its begin."""
    out, last_old, last_new = [], 0, 0
    for i, j, n in covers:
        out.append((pack_signed(i - last_old), pack_varint(j - last_new), pack_varint(n)))
        last_old, last_new = i + (n if from_end else 0), j + n
    return out


class _Covers:
    """Decodes cover codes in order."""

    def __init__(self, from_end: bool) -> None:
        self.from_end, self.old, self.new = from_end, 0, 0

    def next(self, old: Reader, new: Reader, length: Reader) -> Cover:
        i = self.old + read_signed(old)
        j = self.new + new.varint()
        n = length.varint()
        self.old, self.new = i + (n if self.from_end else 0), j + n
        return i, j, n


# plain: four integer streams, literals, runs over the whole of new


def encode_plain(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> bytes:
    _checked(covers, old, new)
    codes = _cover_codes(covers, False)
    lengths, gaps, olds = (b"".join(c[k] for c in codes) for k in (2, 1, 0))
    parts = b"".join(literals(new, covers))
    whole = np.zeros(len(new), np.uint8)
    for (_, j, n), difference in zip(covers, _differences(old, new, covers), strict=True):
        whole[j : j + n] = as_array(difference)
    control, code = pack_runs(whole)
    head = b"".join(map(pack_varint, (len(covers), len(lengths), len(gaps), len(olds), len(parts))))
    return head + lengths + gaps + olds + parts + pack_varint(len(control)) + control + code


def decode_plain(old: np.ndarray, data: bytes, new_size: int) -> bytes:
    reader = Reader(data)
    count, *sizes = (reader.varint() for _ in range(5))
    lengths, gaps, olds = (Reader(reader.take(n)) for n in sizes[:3])
    parts = Reader(reader.take(sizes[3]))
    whole = unpack_runs(reader.take(reader.varint()), reader.rest(), new_size)
    state, covers, pieces, differences, end = _Covers(False), [], [], [], 0
    for _ in range(count):
        i, j, n = state.next(olds, gaps, lengths)
        pieces.append(parts.take(j - end))
        covers.append((i, j, n))
        differences.append(whole[j : j + n].tobytes())
        end = j + n
    for rest in (lengths, gaps, olds):
        rest.end()
    return apply_covers(old, new_size, covers, [*pieces, parts.rest()], differences)


# sections: covers, run control, run code and literals, each compressed


def encode_sections(old: np.ndarray, new: np.ndarray, covers: list[Cover], kind: str = "", tag: bytes = SECTIONS_TAG) -> bytes:
    _checked(covers, old, new)
    control, code = pack_runs(as_array(b"".join(_differences(old, new, covers))))
    sections = [b"".join(b"".join(c) for c in _cover_codes(covers, True)), control, code, b"".join(literals(new, covers))]
    packed = [compress(kind, s) if kind else b"" for s in sections]
    packed = [p if p and len(p) < len(s) else b"" for p, s in zip(packed, sections, strict=True)]
    head = tag + b"&" + kind.encode() + b"\0" + b"".join(map(pack_varint, (len(new), len(old), len(covers))))
    head += b"".join(pack_varint(len(s)) + pack_varint(len(p)) for s, p in zip(sections, packed, strict=True))
    return head + b"".join(p or s for s, p in zip(sections, packed, strict=True))


def _read_sections(data: bytes, tag: bytes) -> tuple[DiffInfo, list[bytes]]:
    reader = Reader(data)
    if reader.until(b"&") != tag:
        raise ValueError("another container")
    kind = reader.until(b"\0").decode()
    new_size, old_size, count = (reader.varint() for _ in range(3))
    sizes = [(reader.varint(), reader.varint()) for _ in range(4)]
    if any(p > s for s, p in sizes):
        raise ValueError("a compressed section is larger than its data")
    sections = [decompress(kind, reader.take(p), s) if p else reader.take(s) for s, p in sizes]
    reader.end()
    return DiffInfo("sections", kind, old_size, new_size, count), sections


def decode_sections(old: np.ndarray, data: bytes, tag: bytes = SECTIONS_TAG) -> bytes:
    info, (codes, control, code, parts) = _read_sections(data, tag)
    if info.old_size != len(old):
        raise ValueError("another old stream")
    covers = covers_in_sections(codes, info.covers)
    if not check_covers(covers, len(old), info.new_size):
        raise ValueError("covers are not in order or out of bounds")
    flat = unpack_runs(control, code, sum(n for *_, n in covers))
    at = np.cumsum([0, *(n for *_, n in covers)])
    differences = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    reader, pieces, end = Reader(parts), [], 0
    for _, j, n in covers:
        pieces.append(reader.take(j - end))
        end = j + n
    return apply_covers(old, info.new_size, covers, [*pieces, reader.rest()], differences)


def covers_in_sections(codes: bytes, count: int) -> list[Cover]:
    reader, state = Reader(codes), _Covers(True)
    covers = [state.next(reader, reader, reader) for _ in range(count)]
    reader.end()
    return covers


def resave_sections(data: bytes, kind: str, tag: bytes = SECTIONS_TAG) -> bytes:
    """The same covers and bytes under another compressor."""
    info, sections = _read_sections(data, tag)
    packed = [compress(kind, s) if kind else b"" for s in sections]
    packed = [p if p and len(p) < len(s) else b"" for p, s in zip(packed, sections, strict=True)]
    head = tag + b"&" + kind.encode() + b"\0" + b"".join(map(pack_varint, (info.new_size, info.old_size, info.covers)))
    head += b"".join(pack_varint(len(s)) + pack_varint(len(p)) for s, p in zip(sections, packed, strict=True))
    return head + b"".join(p or s for s, p in zip(sections, packed, strict=True))


# steps: one stream of steps, each with its covers, runs and literals


def step_rows(old: np.ndarray, new: np.ndarray, covers: list[Cover], step_bytes: int = STEP_BYTES) -> list[tuple[list[Cover], bytes, list[bytes]]]:
    """(covers, zero-run code of their differences, literals) of every step;
    the last step has one literal more, the tail of ``new``."""
    _checked(covers, old, new)
    out, end = [], 0
    steps = steps_of(covers, max(1, step_bytes))
    for number, step in enumerate(steps):
        parts = []
        for _, j, n in step:
            parts.append(new[end:j].tobytes())
            end = j + n
        if number + 1 == len(steps):
            parts.append(new[end:].tobytes())
        out.append((step, pack_zero_runs(as_array(b"".join(_differences(old, new, step)))), parts))
    return out


def encode_steps(old: np.ndarray, new: np.ndarray, covers: list[Cover], kind: str = "", step_bytes: int = STEP_BYTES, tag: bytes = STEPS_TAG) -> bytes:
    rows = step_rows(old, new, covers, step_bytes)
    codes = iter(_cover_codes([c for step, *_ in rows for c in step], True))
    body = []
    for step, run_code, parts in rows:
        cover_code = b"".join(b"".join(next(codes)) for _ in step)
        body += [pack_varint(len(step)), pack_varint(len(cover_code)), pack_varint(len(run_code)), cover_code, run_code, *parts]
    flat = b"".join(body)
    packed = compress(kind, flat) if kind else b""
    packed = packed if packed and len(packed) < len(flat) else b""
    count = sum(len(step) for step, *_ in rows)
    numbers = (len(new), len(old), count, len(rows), min(step_bytes, max(len(new), STEP_LIMIT)), len(flat), len(packed))
    return tag + b"&" + kind.encode() + b"\0" + b"".join(map(pack_varint, numbers)) + (packed or flat)


def encode_literal_steps(new: np.ndarray, old_size: int, covers: list[Cover], kind: str = "", step_bytes: int = STEP_BYTES) -> bytes:
    """A steps container from covers that are equal bytes, without old.

    The old stream is stood in for by the covered bytes of new themselves.
    """
    stand_in = np.zeros(old_size, np.uint8)
    for i, j, n in covers:
        stand_in[i : i + n] = new[j : j + n]
    return encode_steps(stand_in, new, covers, kind, step_bytes)


def _read_steps(data: bytes, tag: bytes) -> tuple[DiffInfo, int, bytes]:
    reader = Reader(data)
    if reader.until(b"&") != tag:
        raise ValueError("another container")
    kind = reader.until(b"\0").decode()
    new_size, old_size, count, steps, step_bytes, size, packed = (reader.varint() for _ in range(7))
    if packed > size or step_bytes > max(new_size, STEP_LIMIT):
        raise ValueError("a size in the head is out of range")
    body = decompress(kind, reader.take(packed), size) if packed else reader.take(size)
    reader.end()
    return DiffInfo("steps", kind, old_size, new_size, count, step_bytes), steps, body


def decode_steps(old: np.ndarray, data: bytes, tag: bytes = STEPS_TAG) -> bytes:
    info, steps, body = _read_steps(data, tag)
    if info.old_size != len(old):
        raise ValueError("another old stream")
    reader, state, made, covers = Reader(body), _Covers(True), 0, 0
    out: list[bytes] = []
    for _ in range(steps):
        count, cover_size, run_size = (reader.varint() for _ in range(3))
        codes, run_code = Reader(reader.take(cover_size)), reader.take(run_size)
        step = [state.next(codes, codes, codes) for _ in range(count)]
        codes.end()
        covers += count
        if not check_covers(step, len(old), info.new_size):
            raise ValueError("covers are not in order or out of bounds")
        total = sum(n for *_, n in step)
        difference, at = unpack_zero_runs(run_code, total), 0
        for i, j, n in step:
            if j < made:
                raise ValueError("a cover is out of order")
            out += [reader.take(j - made), (old[i : i + n] + difference[at : at + n]).tobytes()]
            made, at = j + n, at + n
    out.append(reader.take(info.new_size - made))
    reader.end()
    if covers != info.covers:
        raise ValueError("another number of covers")
    return b"".join(out)


# lite: covers with their literals and differences inline


def encode_lite(old: np.ndarray, new: np.ndarray, covers: list[Cover], kind: str = "", extra: int | None = None, tag: bytes = LITE_TAG) -> bytes:
    """``extra`` makes it an in-place container that keeps so many bytes aside."""
    _checked(covers, old, new)
    if extra is not None and any(i + extra < j for i, j, _ in covers):
        raise ValueError("a cover is not safe in place")
    codes, parts = _cover_codes(covers, True), literals(new, covers)
    body = []
    for code, part, difference in zip(codes, parts[:-1], _differences(old, new, covers), strict=True):
        plain = not any(difference)
        body += [bytes([plain]), *code, part, b"" if plain else difference]
    flat = b"".join(body) + parts[-1]
    packed = compress(kind, flat) if kind else b""
    packed = packed if packed and len(packed) < len(flat) else b""
    numbers = (len(new), len(old), len(covers), 0 if extra is None else extra + 1, len(flat), len(packed))
    return tag + b"&" + kind.encode() + b"\0" + b"".join(map(pack_varint, numbers)) + (packed or flat)


def decode_lite(old: np.ndarray, data: bytes, tag: bytes = LITE_TAG) -> bytes:
    reader = Reader(data)
    if reader.until(b"&") != tag:
        raise ValueError("another container")
    kind = reader.until(b"\0").decode()
    new_size, old_size, count, extra, size, packed = (reader.varint() for _ in range(6))
    if old_size != len(old) or packed > size:
        raise ValueError("another old stream or a wrong head")
    body = Reader(decompress(kind, reader.take(packed), size) if packed else reader.take(size))
    reader.end()
    state, out, made = _Covers(True), [], 0
    for _ in range(count):
        plain = body.take(1)[0]
        i, j, n = state.next(body, body, body)
        if i < 0 or j < made or i + n > len(old) or j + n > new_size or extra and i + extra - 1 < j:
            raise ValueError("a cover is out of bounds")
        out.append(body.take(j - made))
        piece = old[i : i + n]
        out.append((piece if plain else piece + as_array(body.take(n))).tobytes())
        made = j + n
    out.append(body.take(new_size - made))
    body.end()
    return b"".join(out)


def patch_in_place(memory: bytearray, old_size: int, data: bytes, tag: bytes = LITE_TAG) -> bytearray:
    """Apply an in-place container over the memory that holds the old stream.

    Bytes are written behind a queue of ``extra`` bytes, so none is overwritten
    before a later cover reads it.
    """
    reader = Reader(data)
    reader.until(b"&")
    reader.until(b"\0")
    extra = [reader.varint() for _ in range(4)][3] - 1
    if extra < 0:
        raise ValueError("not an in-place container")
    old = as_array(bytes(memory[:old_size]))
    made = decode_lite(old, data, tag)
    queue, written = bytearray(), 0
    memory.extend(b"\0" * (len(made) - len(memory)))
    for at in range(0, len(made), 4096):
        queue += made[at : at + 4096]
        ready = max(0, len(queue) - extra)
        memory[written : written + ready] = queue[:ready]
        del queue[:ready]
        written += ready
    memory[written : written + len(queue)] = queue
    del memory[len(made) :]
    return memory


# bsdiff 4 and its interleaved variant


def bsdiff_covers(covers: list[Cover], new_size: int) -> list[Cover]:
    """Covers as bsdiff controls: the first at (0, 0), the last empty at the end."""
    out = covers if covers and covers[0][:2] == (0, 0) else [(0, 0, 0), *covers]
    return [*out, (out[-1][0] + out[-1][2], new_size, 0)]


def _offset(value: int) -> bytes:
    return struct.pack("<Q", abs(value) | (1 << 63 if value < 0 else 0))


def _read_offset(data: bytes) -> int:
    (value,) = struct.unpack("<Q", data)
    size = value & ((1 << 63) - 1)
    return -size if value >> 63 else size


def _controls(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> list[tuple[bytes, bytes, int]]:
    """(difference, literal behind it, skip in old) of each control."""
    _checked(covers, old, new)
    all_covers, out = bsdiff_covers(covers, len(new)), []
    for (i, j, n), (i2, j2, _) in zip(all_covers[:-1], all_covers[1:], strict=True):
        out.append(((new[j : j + n] - old[i : i + n]).tobytes(), new[j + n : j2].tobytes(), i2 - i - n))
    return out


def encode_bsdiff(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> bytes:
    controls = _controls(old, new, covers)
    control = bz2.compress(b"".join(_offset(len(d)) + _offset(len(x)) + _offset(s) for d, x, s in controls))
    difference = bz2.compress(b"".join(d for d, *_ in controls))
    extra = bz2.compress(b"".join(x for _, x, _ in controls))
    return b"BSDIFF40" + _offset(len(control)) + _offset(len(difference)) + _offset(len(new)) + control + difference + extra


def _all(data: bytes, limit: int) -> bytes:
    try:
        out = bz2.BZ2Decompressor().decompress(data, min(limit, 1 << 40) + 1)
    except OSError as error:
        raise ValueError("bad bz2 data") from error
    if len(out) > limit:
        raise ValueError("a section is longer than it may be")
    return out


def _apply_controls(old: np.ndarray, new_size: int, controls) -> bytes:  # noqa: ANN001
    out, made, at = [], 0, 0
    for difference, extra, skip in controls:
        n = len(difference)
        if at < 0 or at + n > len(old) or made + n + len(extra) > new_size:
            raise ValueError("a control is out of bounds")
        out += [(old[at : at + n] + as_array(difference)).tobytes(), extra]
        made, at = made + n + len(extra), at + n + skip
    if made != new_size:
        raise ValueError("controls fall short of the new stream")
    return b"".join(out)


def decode_bsdiff(old: np.ndarray, data: bytes) -> bytes:
    reader = Reader(data)
    if reader.take(8) != b"BSDIFF40":
        raise ValueError("another container")
    control_size, difference_size, new_size = (_read_offset(reader.take(8)) for _ in range(3))
    if min(control_size, difference_size, new_size) < 0:
        raise ValueError("a negative size")
    raw = reader.take(control_size)
    difference = Reader(_all(reader.take(difference_size), new_size))
    extra = Reader(_all(reader.rest(), new_size))
    control = Reader(_all(raw, 24 * (2 * new_size + 2)))

    def controls():  # noqa: ANN202
        made = 0
        while made < new_size:
            n, x, skip = (_read_offset(control.take(8)) for _ in range(3))
            if n < 0 or x < 0 or not (n or x or skip):
                raise ValueError("an empty or negative control")
            made += n + x
            yield difference.take(n), extra.take(x), skip

    return _apply_controls(old, new_size, controls())


def encode_endsley(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> bytes:
    """The variant with control, difference and literal in turn in one stream."""
    body = b"".join(_offset(len(d)) + _offset(len(x)) + _offset(s) + d + x for d, x, s in _controls(old, new, covers))
    return b"ENDSLEY/BSDIFF43" + _offset(len(new)) + bz2.compress(body)


def decode_endsley(old: np.ndarray, data: bytes) -> bytes:
    reader = Reader(data)
    if reader.take(16) != b"ENDSLEY/BSDIFF43":
        raise ValueError("another container")
    new_size = _read_offset(reader.take(8))
    if new_size < 0:
        raise ValueError("a negative size")
    body = Reader(_all(reader.rest(), 25 * (2 * new_size + 2)))

    def controls():  # noqa: ANN202
        made = 0
        while made < new_size:
            n, x, skip = (_read_offset(body.take(8)) for _ in range(3))
            if n < 0 or x < 0 or not (n or x or skip):
                raise ValueError("an empty or negative control")
            made += n + x
            yield body.take(n), body.take(x), skip

    return _apply_controls(old, new_size, controls())


# VCDIFF

VCD_MAGIC, VCD_SOURCE, VCD_ADLER = b"\xd6\xc3\xc4\x00", 1, 4
VCD_WINDOW = 16 << 20


def _vcd_int(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def _read_vcd_int(reader: Reader) -> int:
    value = 0
    while True:
        byte = reader.take(1)[0]
        value = value << 7 | byte & 127
        if value >> 63:
            raise ValueError("integer of more than 63 bits")
        if byte < 128:
            return value


def _code_table() -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """The default instructions (type, size, mode) x 2 of RFC 3284, by its rule:
    0 none, 1 ADD, 2 RUN, 3 COPY."""
    none = (0, 0, 0)
    out = [((2, 0, 0), none)] + [((1, size, 0), none) for size in range(18)]
    for mode in range(9):
        out += [((3, size, mode), none) for size in (0, *range(4, 19))]
    for mode in range(6):
        out += [((1, add, 0), (3, copy, mode)) for add in range(1, 5) for copy in range(4, 7)]
    for mode in range(6, 9):
        out += [((1, add, 0), (3, 4, mode)) for add in range(1, 5)]
    return out + [((3, 4, mode), (1, 1, 0)) for mode in range(9)]


class AddressCache:
    """Near and same caches of copy addresses (4 near, 3 x 256 same)."""

    def __init__(self) -> None:
        self.near, self.turn, self.same = [0] * 4, 0, [0] * 768

    def update(self, address: int) -> None:
        self.near[self.turn] = address
        self.turn = (self.turn + 1) % 4
        self.same[address % 768] = address

    def encode(self, address: int, here: int) -> tuple[int, bytes]:
        """(mode, code) with the shortest code; the first mode on a tie."""
        options = [(0, _vcd_int(address)), (1, _vcd_int(here - address))]
        options += [(2 + k, _vcd_int(address - near)) for k, near in enumerate(self.near) if address >= near]
        if self.same[address % 768] == address:
            options.append((6 + address % 768 // 256, bytes([address % 256])))
        best = min(options, key=lambda o: (len(o[1]), o[0]))
        self.update(address)
        return best

    def decode(self, reader: Reader, mode: int, here: int) -> int:
        if mode == 0:
            address = _read_vcd_int(reader)
        elif mode == 1:
            address = here - _read_vcd_int(reader)
        elif mode < 6:
            address = self.near[mode - 2] + _read_vcd_int(reader)
        else:
            address = self.same[(mode - 6) * 256 + reader.take(1)[0]]
        if not 0 <= address < here:
            raise ValueError("a copy address is out of bounds")
        self.update(address)
        return address


def _exact(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> list[Cover]:
    """The runs of equal bytes of 4 or more inside covers."""
    out = []
    for i, j, n in covers:
        equal = (old[i : i + n] == new[j : j + n]).astype(np.int8)
        edge = np.flatnonzero(np.diff(np.r_[0, equal, 0]))
        out += [(i + int(a), j + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 4]
    return out


def encode_vcdiff(old: np.ndarray, new: np.ndarray, covers: list[Cover], window: int = VCD_WINDOW) -> bytes:
    """Windows of ``window`` target bytes, each with the whole old as source."""
    _checked(covers, old, new)
    exact = _exact(old, new, covers)
    out = [VCD_MAGIC + b"\0"]
    for begin in range(0, len(new), window) if len(new) else ():
        end = min(begin + window, len(new))
        inside = [(i + max(0, begin - j), max(j, begin), min(j + n, end) - max(j, begin)) for i, j, n in exact if j < end and j + n > begin]
        data, codes, addresses, cache, at = [], [], [], AddressCache(), begin

        def add(upto: int, at: int) -> None:
            part = new[at:upto]
            if len(part) >= 4 and (part == part[0]).all():
                codes.append(bytes([0]) + _vcd_int(len(part)))
                data.append(part[:1].tobytes())
            elif len(part):
                codes.append(bytes([1 + len(part)]) if len(part) <= 17 else bytes([1]) + _vcd_int(len(part)))
                data.append(part.tobytes())

        for i, j, n in inside:
            add(j, at)
            mode, code = cache.encode(i, len(old) + j - begin)
            codes.append(bytes([19 + 16 * mode + n - 3]) if 4 <= n <= 18 else bytes([19 + 16 * mode]) + _vcd_int(n))
            addresses.append(code)
            at = j + n
        add(end, at)
        sections = [b"".join(x) for x in (data, codes, addresses)]
        head = _vcd_int(end - begin) + b"\0" + b"".join(_vcd_int(len(x)) for x in sections) + struct.pack(">I", zlib.adler32(new[begin:end].tobytes()))
        body = head + b"".join(sections)
        source = bytes([VCD_ADLER | (VCD_SOURCE if len(old) else 0)]) + (_vcd_int(len(old)) + _vcd_int(0) if len(old) else b"")
        out.append(source + _vcd_int(len(body)) + body)
    return b"".join(out)


def decode_vcdiff(old: np.ndarray, data: bytes, limit: int = 1 << 31) -> bytes:
    """Source and target windows; the Adler sum of a window is checked if there."""
    reader = Reader(data)
    if reader.take(4)[:3] != VCD_MAGIC[:3]:
        raise ValueError("another container")
    head = reader.take(1)[0]
    if head & 3:
        raise ValueError("secondary compressors and code tables are not supported")
    if head & 4:
        reader.take(_read_vcd_int(reader))
    made, table = bytearray(), _code_table()
    old_bytes = old.tobytes()
    while reader.left():
        flags = reader.take(1)[0]
        source = b""
        if flags & 3:
            size, at = _read_vcd_int(reader), _read_vcd_int(reader)
            whole = old_bytes if flags & VCD_SOURCE else bytes(made)
            if at + size > len(whole):
                raise ValueError("a source window is out of bounds")
            source = whole[at : at + size]
        body = Reader(reader.take(_read_vcd_int(reader)))
        size = _read_vcd_int(body)
        if len(made) + size > limit or body.take(1)[0]:
            raise ValueError("a window is too large or compressed")
        sizes = [_read_vcd_int(body) for _ in range(3)]
        check = struct.unpack(">I", body.take(4))[0] if flags & VCD_ADLER else None
        values, codes, addresses = (Reader(body.take(n)) for n in sizes)
        body.end()
        window, cache = bytearray(source), AddressCache()
        full = len(source) + size
        while codes.left():
            for kind, n, mode in table[codes.take(1)[0]]:
                if not kind:
                    continue
                n = n or _read_vcd_int(codes)
                if len(window) + n > full:
                    raise ValueError("an instruction exceeds its window")
                if kind == 1:
                    window += values.take(n)
                elif kind == 2:
                    window += values.take(1) * n
                else:
                    start = cache.decode(addresses, mode, len(window))
                    while n:
                        part = window[start : start + n]
                        window += part
                        start, n = start + len(part), n - len(part)
        if len(window) != full:
            raise ValueError("a window falls short of its size")
        target = bytes(window[len(source) :])
        if check is not None and zlib.adler32(target) != check:
            raise ValueError("a window has another checksum")
        made += target
    return bytes(made)


ENCODE = {
    "plain": encode_plain,
    "sections": encode_sections,
    "steps": encode_steps,
    "lite": encode_lite,
    "bsdiff": encode_bsdiff,
    "endsley": encode_endsley,
    "vcdiff": encode_vcdiff,
}
DECODE = {
    "sections": decode_sections,
    "steps": decode_steps,
    "lite": decode_lite,
    "bsdiff": decode_bsdiff,
    "endsley": decode_endsley,
    "vcdiff": decode_vcdiff,
}


def sniff(data: bytes) -> str | None:
    """The kind of a container by its tag; plain ones have none."""
    tags = [(SECTIONS_TAG + b"&", "sections"), (STEPS_TAG + b"&", "steps"), (LITE_TAG + b"&", "lite"), (b"BSDIFF40", "bsdiff"), (b"ENDSLEY/BSDIFF43", "endsley"), (VCD_MAGIC[:3], "vcdiff")]
    return next((kind for tag, kind in tags if data.startswith(tag)), None)


def encode(kind: str, old: np.ndarray, new: np.ndarray, covers: list[Cover], packing: str = "") -> bytes:
    return ENCODE[kind](old, new, covers, packing) if kind in ("sections", "steps", "lite") else ENCODE[kind](old, new, covers)


def decode(old: np.ndarray, data: bytes, new_size: int | None = None) -> bytes:
    """New bytes from a container of any kind; a plain one needs the size."""
    kind = sniff(data)
    if kind is None:
        if new_size is None:
            raise ValueError("a container without a tag needs the new size")
        return decode_plain(old, data, new_size)
    return DECODE[kind](old, data)


def covers_in(data: bytes) -> list[Cover]:
    """The covers that a section, step or lite container holds."""
    kind = sniff(data)
    if kind == "sections":
        head, (codes, *_) = _read_sections(data, SECTIONS_TAG)
        return covers_in_sections(codes, head.covers)
    if kind == "steps":
        head, steps, body = _read_steps(data, STEPS_TAG)
        reader, state, out, made = Reader(body), _Covers(True), [], 0
        for _ in range(steps):
            count, cover_size, run_size = (reader.varint() for _ in range(3))
            codes = Reader(reader.take(cover_size))
            reader.take(run_size)
            for _ in range(count):
                cover = state.next(codes, codes, codes)
                reader.take(cover[1] - made)
                made = cover[1] + cover[2]
                out.append(cover)
        return out
    if kind == "lite":
        reader = Reader(data)
        reader.until(b"&")
        packing = reader.until(b"\0").decode()
        _, _, count, _, size, packed = (reader.varint() for _ in range(6))
        body = Reader(decompress(packing, reader.take(packed), size) if packed else reader.take(size))
        state, out, made = _Covers(True), [], 0
        for _ in range(count):
            plain = body.take(1)[0]
            cover = state.next(body, body, body)
            body.take(cover[1] - made)
            body.take(0 if plain else cover[2])
            made = cover[1] + cover[2]
            out.append(cover)
        return out
    raise ValueError("no covers to read")


def info(data: bytes) -> DiffInfo:
    """What the head of a container tells."""
    kind = sniff(data)
    if kind == "sections":
        return _read_sections(data, SECTIONS_TAG)[0]
    if kind == "steps":
        return _read_steps(data, STEPS_TAG)[0]
    if kind == "lite":
        reader = Reader(data)
        reader.until(b"&")
        packing = reader.until(b"\0").decode()
        new_size, old_size, count = (reader.varint() for _ in range(3))
        return DiffInfo(kind, packing, old_size, new_size, count)
    raise ValueError("no head to read")
