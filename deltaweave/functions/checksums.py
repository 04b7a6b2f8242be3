"""Checksums of byte columns: Adler variants, rolling sums, digests.

The Adler family keeps two sums over bytes T(b) (the byte itself, or an entry
of a table): a = 1 + sum T and s = the sum of all a, each modulo a base.  For a
window, with d the sum of T over it and e the sum of T times the place counted
from the end (last byte 1), a = 1 + d and s = n + e.  Modulo 2**32 these wrap
exactly in unsigned 64-bit arithmetic; a prime base is reduced blockwise.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

BASE_16, BASE_32, BASE_ZSYNC = 65521, 0xFFFFFFFB, 1 << 16


def rule_table() -> np.ndarray:
    """The default byte table: (b + 1) * 2654435761 modulo 2**32."""
    return (np.arange(1, 257, dtype=np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)


#: Bytes whose weighted sums of 32-bit values stay in 64 bits.
_PART = 1 << 12


def adler(data: np.ndarray, base: int, table: np.ndarray | None = None, initial: int = 1) -> tuple[int, int]:
    """(a, s) of some bytes; ``initial`` is 0 for the zsync form."""
    a, s = initial, 0
    for at in range(0, len(data), _PART):
        part = data[at : at + _PART]
        values = part.astype(np.uint64) if table is None else table[part]
        n = len(part)
        place = np.arange(n, 0, -1, dtype=np.uint64)
        d = int(values.sum())
        e = int((values * place).sum())
        s = (s + n * a + e) % base
        a = (a + d) % base
    return a, s


def combine(left: tuple[int, int], right: tuple[int, int], right_size: int, base: int, initial: int = 1) -> tuple[int, int]:
    """The sums of two parts in a row, from the sums of each."""
    return (left[0] + right[0] - initial) % base, (left[1] + right[1] + right_size * (left[0] - initial)) % base


def roll(sums: tuple[int, int], size: int, gone: int, come: int, base: int, initial: int = 1) -> tuple[int, int]:
    """The sums one byte further: the (table) value ``gone`` left, ``come`` joined."""
    a = (sums[0] - gone + come) % base
    return a, (sums[1] + a - initial - size * gone) % base


def rolling(data: np.ndarray, size: int, bits: int, table: np.ndarray | None = None, initial: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(a, s) modulo 2**bits of the window of ``size`` at every offset."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    values = data.astype(np.uint64) if table is None else table[data]
    first = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    second = np.r_[np.uint64(0), np.cumsum(values * np.arange(len(data), dtype=np.uint64), dtype=np.uint64)]
    at = np.arange(n, dtype=np.uint64)
    d = first[size:] - first[:n]
    e = (at + np.uint64(size)) * d - (second[size:] - second[:n])
    mask = np.uint64((1 << bits) - 1)
    return (np.uint64(initial) + d) & mask, (np.uint64(size * initial) + e) & mask


def _many(blocks: list[bytes], base: int, table: np.ndarray | None, initial: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of many blocks of 1 to ``_PART`` bytes at once."""
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(blocks), np.uint8)
    values = flat.astype(np.uint64) if table is None else table[flat]
    place = (np.repeat(ends, sizes) - np.arange(len(flat))).astype(np.uint64)
    d, e = np.add.reduceat(values, ends - sizes), np.add.reduceat(values * place, ends - sizes)
    whole = np.uint64(base)
    return (np.uint64(initial) + d) % whole, (np.uint64(initial) * sizes.astype(np.uint64) + e) % whole


def _sums(base: int, table: np.ndarray | None, initial: int) -> Callable[[pa.Array], pa.Array]:
    def run(blocks: pa.Array) -> pa.Array:
        raw = [b.as_py() for b in blocks]
        a, s = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        usual = [i for i, b in enumerate(raw) if b and len(b) <= _PART]
        if usual:
            a[usual], s[usual] = _many([raw[i] for i in usual], base, table, initial)
        for i, b in enumerate(raw):
            if b is not None and not 0 < len(b) <= _PART:
                a[i], s[i] = adler(np.frombuffer(b, np.uint8), base, table, initial)
        null = np.array([b is None for b in raw], bool)
        return pa.StructArray.from_arrays([pa.array(a, mask=null), pa.array(s, mask=null)], ["a", "s"])

    return run


_PAIR = StructType([StructField("a", LongType()), StructField("s", LongType())])


def adler32(block: Column) -> Column:
    """Struct (a, s) modulo 65521; a + s * 65536 is the usual Adler-32."""
    return F.arrow_udf(_sums(BASE_16, None, 1), _PAIR)(block)


def adler64(block: Column) -> Column:
    """Struct (a, s) modulo 0xFFFFFFFB."""
    return F.arrow_udf(_sums(BASE_32, None, 1), _PAIR)(block)


def fadler64(block: Column, table: np.ndarray | None = None) -> Column:
    """Struct (a, s) of table values modulo 2**32; the table is a parameter."""
    return F.arrow_udf(_sums(1 << 32, rule_table() if table is None else table, 1), _PAIR)(block)


def fadler32(block: Column, table: np.ndarray | None = None) -> Column:
    """Struct (a, s) of 16-bit table values modulo 2**16."""
    found = rule_table() >> np.uint64(16) if table is None else table
    return F.arrow_udf(_sums(1 << 16, found & np.uint64(0xFFFF), 1), _PAIR)(block)


def wide_table() -> np.ndarray:
    """The byte table of the widest form: (b + 1) * 0x9E3779B97F4A7C15 modulo 2**64."""
    return np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fadler128(block: Column, table: np.ndarray | None = None) -> Column:
    """Struct (a, s) of 64-bit table values modulo 2**64, as signed LONGs."""
    values = wide_table() if table is None else table

    def run(blocks: pa.Array) -> pa.Array:
        out = []
        for block in blocks:
            data = values[np.frombuffer(block.as_py() or b"", np.uint8)]
            place = np.arange(len(data), 0, -1, dtype=np.uint64)
            out.append((np.uint64(1) + data.sum(dtype=np.uint64), np.uint64(len(data)) + (data * place).sum(dtype=np.uint64)))
        sums = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        null = np.array([not b.is_valid for b in blocks], bool)
        return pa.StructArray.from_arrays([pa.array(sums[:, 0].copy(), mask=null), pa.array(sums[:, 1].copy(), mask=null)], ["a", "s"])

    return F.arrow_udf(run, _PAIR)(block)


def zsync_roll(block: Column) -> Column:
    """Struct (a, s) of plain bytes modulo 2**16, from zero."""
    return F.arrow_udf(_sums(BASE_ZSYNC, None, 0), _PAIR)(block)


#: Digests that Spark has itself.
NATIVE: dict[str, Callable[[Column], Column]] = {
    "crc32": lambda c: F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0"),
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
}


def _python_digests() -> dict[str, Callable[[bytes], str]]:
    found = {
        "adler32": lambda b: f"{zlib.adler32(b):08x}",
        "blake2b": lambda b: hashlib.blake2b(b).hexdigest(),
    }
    from ..sources.zsync import md4

    found["md4"] = lambda b: md4(b).hex()
    for bits, base, table in ((32, 1 << 16, (rule_table() >> np.uint64(16)) & np.uint64(0xFFFF)), (64, 1 << 32, rule_table())):
        found[f"fadler{bits}"] = lambda b, base=base, table=table, width=bits // 8: "".join(f"{x:0{width}x}" for x in reversed(adler(np.frombuffer(b, np.uint8), base, table)))
    try:
        import xxhash
    except ImportError:
        return found
    return found | {"xxh3": lambda b: xxhash.xxh3_64_hexdigest(b), "xxh128": lambda b: xxhash.xxh3_128_hexdigest(b)}


def digest(kind: str, content: Column) -> Column:
    """Lower-case hex digest of bytes by name; unknown names raise."""
    if kind in NATIVE:
        return NATIVE[kind](content)
    table = _python_digests()
    if kind not in table:
        raise ValueError(f"no checksum {kind!r}")
    from pyspark.sql.types import StringType

    def run(values: pa.Array) -> pa.Array:
        one = _python_digests()[kind]
        return pa.array([one(v.as_py()) if v.is_valid else None for v in values], pa.string())

    return F.arrow_udf(run, StringType())(content)


def fold_bits(value: Column, bits: int) -> Column:
    """((h >> k) xor h) limited to k bits."""
    return F.shiftrightunsigned(value, bits).bitwiseXOR(value).bitwiseAND(F.lit((1 << bits) - 1))


def truncate_digest(hex_digest: Column, bits: int) -> Column:
    """The first whole bytes that hold ``bits``, surplus high bits cleared."""
    size = -(-bits // 8)
    head = F.substring(hex_digest, 1, 2 * size)
    if not bits % 8:
        return head
    low = F.conv(F.substring(head, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit((1 << bits % 8) - 1))
    return F.concat(F.lpad(F.lower(F.hex(low.cast("long"))), 2, "0"), F.substring(head, 3, 2 * size))


def ceil_log2(value: int) -> int:
    """The least k of one or more with 2**k >= value."""
    return max(1, (max(1, value) - 1).bit_length())


def ceil_log2_of(value: Column) -> Column:
    """:func:`ceil_log2` of a LONG column."""
    return F.when(value <= 2, F.lit(1)).otherwise(F.length(F.bin(value - 1))).cast("long")


def hash_bits_of(stream_size: Column, blocks: Column, safe_bits: int = 24, least: int = 14) -> tuple[Column, Column]:
    """:func:`hash_bits` of columns."""
    total = ceil_log2_of(stream_size) + ceil_log2_of(blocks) + max(safe_bits, least)
    rolling_bits = F.least(F.greatest(ceil_log2_of(stream_size) + 1, F.lit(least)), F.lit(32)).cast("long")
    return rolling_bits, F.greatest(total - rolling_bits, F.lit(least)).cast("long")


def hash_bits(stream_size: int, blocks: int, safe_bits: int = 24, least: int = 14) -> tuple[int, int]:
    """(rolling bits, strong bits) so that a false match is 2**-safe_bits likely.

    The rolling part tells apart the windows of a stream, the strong part the
    rest of the budget, no less than ``least`` each.
    """
    total = ceil_log2(stream_size) + ceil_log2(blocks) + max(safe_bits, least)
    rolling_bits = min(max(ceil_log2(stream_size) + 1, least), 32)
    return rolling_bits, max(total - rolling_bits, least)


def each_chunk(values: Iterator[bytes], kind: str) -> str:
    """A digest over ordered chunks: begin, append, end."""
    maker = {"crc32": None, "adler32": None}.get(kind, kind)
    if maker is None:
        step, total = (zlib.crc32, 0) if kind == "crc32" else (zlib.adler32, 1)
        for value in values:
            total = step(value, total)
        return f"{total:08x}"
    state = hashlib.new(maker)
    for value in values:
        state.update(value)
    return state.hexdigest()
