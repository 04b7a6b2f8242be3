import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.functions import checksums as c

DATA = np.random.default_rng(4).integers(0, 256, 9000, dtype=np.uint8)


def test_adler_equals_zlib():
    for n in (0, 1, 100, 9000):
        a, s = c.adler(DATA[:n], c.BASE_16)
        assert a + (s << 16) == zlib.adler32(DATA[:n].tobytes())


@pytest.mark.parametrize(("base", "table", "initial"), [(1 << 32, c.rule_table(), 1), (c.BASE_16, None, 1), (c.BASE_ZSYNC, None, 0), (c.BASE_32, None, 1)])
def test_roll_and_combine(base, table, initial):
    value = (lambda i: int(DATA[i])) if table is None else (lambda i: int(table[DATA[i]]))
    sums = c.adler(DATA[:64], base, table, initial)
    for i in range(40):
        sums = c.roll(sums, 64, value(i), value(i + 64), base, initial)
        assert sums == c.adler(DATA[i + 1 : i + 65], base, table, initial)
    both = c.combine(c.adler(DATA[:500], base, table, initial), c.adler(DATA[500:1300], base, table, initial), 800, base, initial)
    assert both == c.adler(DATA[:1300], base, table, initial)


def test_rolling_windows():
    a, s = c.rolling(DATA, 32, 32, c.rule_table())
    for i in (0, 17, len(DATA) - 32):
        assert (int(a[i]), int(s[i])) == c.adler(DATA[i : i + 32], 1 << 32, c.rule_table())
    assert len(c.rolling(DATA[:5], 32, 32)[0]) == 0


def test_digests(spark):
    raw = DATA[:777].tobytes()
    df = spark.createDataFrame([(raw,), (b"",), (None,)], "b binary")
    for kind in ("md5", "sha1", "sha256", "sha512", "crc32", "adler32"):
        got = [r[0] for r in df.select(c.digest(kind, F.col("b"))).collect()]
        want = f"{getattr(zlib, kind)(raw):08x}" if kind in ("crc32", "adler32") else hashlib.new(kind, raw).hexdigest()
        assert got[0] == want and got[2] is None
    with pytest.raises(ValueError):
        c.digest("none", F.col("b"))
    assert c.each_chunk(iter([raw[:100], raw[100:]]), "md5") == hashlib.md5(raw).hexdigest()
    assert c.each_chunk(iter([raw[:100], raw[100:]]), "crc32") == f"{zlib.crc32(raw):08x}"


def test_block_sums(spark):
    blocks = [DATA[:64].tobytes(), b"", None, DATA[:9000].tobytes(), b"x", DATA[100:4196].tobytes()]
    df = spark.createDataFrame([(b,) for b in blocks], "b binary")
    makers = [(c.adler32, c.BASE_16, None, 1), (c.adler64, c.BASE_32, None, 1), (c.fadler64, 1 << 32, c.rule_table(), 1), (c.zsync_roll, c.BASE_ZSYNC, None, 0)]
    for make, base, table, initial in makers:
        got = [(r[0]["a"], r[0]["s"]) for r in df.select(make(F.col("b"))).collect()]
        assert got == [(None, None) if b is None else c.adler(np.frombuffer(b, np.uint8), base, table, initial) for b in blocks]


def test_bits(spark):
    row = spark.createDataFrame([(0x1234567890, "ff00aa")], "h long, d string").select(c.fold_bits(F.col("h"), 16), c.truncate_digest(F.col("d"), 12), c.truncate_digest(F.col("d"), 16)).first()
    assert row[0] == ((0x1234567890 >> 16) ^ 0x1234567890) & 0xFFFF
    assert row[1:] == ("0f00", "ff00")
    assert [c.ceil_log2(n) for n in (0, 1, 2, 3, 4, 5, 1024, 1025)] == [1, 1, 1, 2, 2, 3, 10, 11]
    assert c.hash_bits(1 << 30, 1 << 19)[0] >= 14


def test_widest_sums_and_digests(spark):
    from pyspark.sql import functions as F

    from deltaweave.functions import checksums

    data = bytes(range(256)) * 3
    table = [((b + 1) * 0x9E3779B97F4A7C15) % 2**64 for b in range(256)]
    a, s = 1, 0
    for b in data:
        a = (a + table[b]) % 2**64
        s = (s + a) % 2**64
    row = spark.createDataFrame([(data,), (b"",), (None,)], "c binary").select(checksums.fadler128(F.col("c")).alias("x")).collect()
    assert [v % 2**64 for v in row[0]["x"]] == [a, s] and tuple(row[1]["x"]) == (1, 0) and tuple(row[2]["x"]) == (None, None)
    kinds = spark.createDataFrame([(b"abc",)], "c binary").select(*(checksums.digest(k, F.col("c")).alias(k) for k in ("md4", "fadler32", "fadler64"))).first()
    assert kinds["md4"] == "a448017aaf21d8525fc10ae87aa6729d"
    a, s = checksums.adler(__import__("numpy").frombuffer(b"abc", "u1"), 1 << 32, checksums.rule_table())
    assert kinds["fadler64"] == f"{s:08x}{a:08x}" and len(kinds["fadler32"]) == 8


def test_budgets_of_columns_and_numbers(spark):
    from pyspark.sql import functions as F

    from deltaweave.functions import checksums
    from deltaweave.options import block_size_for, block_size_of

    sizes = [1, 2, 3, 64, 65, 1000, 4096, 10**6, 2**40]
    table = spark.createDataFrame([(n, max(1, n // 64)) for n in sizes], "n long, b long")
    r, s = checksums.hash_bits_of(F.col("n"), F.col("b"))
    rows = table.select("n", "b", checksums.ceil_log2_of(F.col("n")).alias("log"), r.alias("r"), s.alias("s"), block_size_of(F.col("n"), 1024).alias("size")).collect()
    for x in rows:
        assert (x["log"], x["r"], x["s"], x["size"]) == (checksums.ceil_log2(x["n"]), *checksums.hash_bits(x["n"], x["b"]), block_size_for(x["n"], 1024))
