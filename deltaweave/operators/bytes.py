"""Byte-grain operators: rows of single bytes, runs, differences, histograms.

A content stays a binary in its row; rows come only at the grain of runs, where
the result is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions import codecs, kernels
from .tables import parts


def _of_rows(kernel: Callable[..., object], kind: pa.DataType, columns: Sequence[pa.Array]) -> pa.Array:
    """A kernel on each row of binaries, some megabytes at a time."""
    batch = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
    made = [pa.array([kernel(*(kernels.as_array(v.as_py()) for v in row)) for row in zip(*part.columns, strict=True)], kind) for part in parts(batch)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def subtract(new: Column, old: Column) -> Column:
    """new - old modulo 256 of two binaries; the shorter one decides the size."""

    def run(n: pa.Array, o: pa.Array) -> pa.Array:
        return _of_rows(lambda x, y: (x[: len(y)] - y[: len(x)]).tobytes(), pa.binary(), (n, o))

    return F.arrow_udf(run, BinaryType())(new, old)


def add(difference: Column, old: Column) -> Column:
    """difference + old modulo 256 of two binaries; the shorter one decides the size."""

    def run(d: pa.Array, o: pa.Array) -> pa.Array:
        return _of_rows(lambda x, y: (x[: len(y)] + y[: len(x)]).tobytes(), pa.binary(), (d, o))

    return F.arrow_udf(run, BinaryType())(difference, old)


def byte_sums(content: Column) -> Column:
    """Struct (bytes, zeros, weighed) of a binary: its size, how many bytes are
    zero, and the bytes weighed by their place, as a number to compare."""
    kinds = [("bytes", LongType()), ("zeros", LongType()), ("weighed", LongType())]

    def kernel(data: np.ndarray) -> dict:
        weighed = int((data * (np.arange(len(data)) % 251 + 1)).sum()) if len(data) else 0
        return {"bytes": len(data), "zeros": len(data) - int(np.count_nonzero(data)), "weighed": weighed}

    def run(values: pa.Array) -> pa.Array:
        return _of_rows(kernel, pa.struct([(n, pa.int64()) for n, _ in kinds]), (values,))

    return F.arrow_udf(run, StructType([StructField(*k) for k in kinds]))(content)


def _per_stream(streams: DataFrame, kernel, kinds: list[tuple[str, str]]) -> DataFrame:  # noqa: ANN001
    names = [n for n, _ in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            found = [kernel(kernels.as_array(v.as_py())) for v in part.column(1)]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            columns = [np.concatenate([np.asarray(f[k], np.int64) for f in found]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["stream_id", *names])

    kind = streams.schema["stream_id"].dataType.simpleString()
    return streams.select("stream_id", "content").mapInArrow(run, f"stream_id {kind}, " + ", ".join(f"{n} {k}" for n, k in kinds))


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, value, length) of the maximal runs of equal bytes."""
    cut = np.flatnonzero(np.r_[True, data[1:] != data[:-1]]) if len(data) else np.zeros(0, np.int64)
    return cut, data[cut], np.diff(np.r_[cut, len(data)]) if len(data) else cut


def runs(streams: DataFrame) -> DataFrame:
    """(stream_id, pos, value, length) of the maximal runs of equal bytes."""
    return _per_stream(streams, _runs, [("pos", "long"), ("value", "long"), ("length", "long")])


def run_lists(streams: DataFrame) -> DataFrame:
    """(stream_id, values, lengths): the runs of a stream in its row, a byte and a
    length each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            found = [_runs(kernels.as_array(v.as_py())) for v in part.column(1)]
            ends = np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int32)
            lengths = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[1].tobytes() for f in found], pa.binary()), lengths], ["stream_id", "values", "lengths"])

    kind = streams.schema["stream_id"].dataType.simpleString()
    return streams.select("stream_id", "content").mapInArrow(run, f"stream_id {kind}, values binary, lengths array<int>")


def zero_runs(streams: DataFrame) -> DataFrame:
    """(stream_id, pos, zeros, others): alternating runs that tile a content."""

    def kernel(data: np.ndarray):  # noqa: ANN202
        zeros, others = codecs.zero_run_sizes(data)
        return np.cumsum(zeros + others) - zeros - others, zeros, others

    return _per_stream(streams, kernel, [("pos", "long"), ("zeros", "long"), ("others", "long")])


def expand_runs(values: Column, lengths: Column) -> Column:
    """The bytes that the runs of :func:`run_lists` describe."""

    def run(v: pa.Array, n: pa.Array) -> pa.Array:
        made = []
        for row, sizes in zip(v, n, strict=True):
            made.append(np.repeat(kernels.as_array(row.as_py()), sizes.values.to_numpy(zero_copy_only=False)).tobytes())
        return pa.array(made, pa.binary())

    return F.arrow_udf(run, BinaryType())(values, lengths)


def region_cost(streams: DataFrame) -> DataFrame:
    """(stream_id, cost) of the runs of a content: leading zeros are free, a run of 0
    or 255 or a single byte costs one, another run two.  Empty ones have no row."""
    return _per_stream(streams, lambda data: ([kernels.region_rle_cost(data)] if len(data) else [],), [("cost", "long")])


def bigram_counts(streams: DataFrame) -> DataFrame:
    """(first, second, n) of adjacent bytes over all streams.

    Every task adds up its own 65,536 counts, so the shuffle does not grow with
    the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for value in batch.column(0):
                data = kernels.as_array(value.as_py()).astype(np.int64)
                if len(data) > 1:
                    total += np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // 256), pa.array(at % 256), pa.array(total[at])], ["first", "second", "n"])

    found = streams.select("content").mapInArrow(run, "first long, second long, n long")
    return found.groupBy("first", "second").agg(F.sum("n").alias("n"))


def recent_bigram_cost(streams: DataFrame, window: int = 512 << 10) -> DataFrame:
    """(stream_id, cost): bits that an adaptive order-one model of the last
    ``window`` bytes gives the stream, in whole bytes."""

    def kernel(data: np.ndarray):  # noqa: ANN202
        pairs, singles, bits = np.zeros(1 << 16, np.int64), np.zeros(256, np.int64), 0.0
        for at in range(0, len(data), 4096):
            part = data[at : at + 4096].astype(np.int64)
            before = np.r_[data[at - 1] if at else 0, data[at : at + 4096][:-1]].astype(np.int64)
            key = before * 256 + part
            bits -= float(np.log2((pairs[key] + 1 / 256) / (singles[before] + 1)).sum())
            np.add.at(pairs, key, 1)
            np.add.at(singles, before, 1)
            if at >= window:
                gone = data[at - window : at - window + 4096].astype(np.int64)
                gone_before = np.r_[data[at - window - 1] if at > window else 0, data[at - window : at - window + 4096][:-1]].astype(np.int64)
                np.add.at(pairs, gone_before * 256 + gone, -1)
                np.add.at(singles, gone_before, -1)
        return ([int(np.ceil(bits / 8))],)

    return _per_stream(streams, kernel, [("cost", "long")])


def window_sums(streams: DataFrame, size: int, table: np.ndarray | None = None) -> DataFrame:
    """(stream_id, windows, low, high, check) of the rolling sums at every offset.

    The two 32-bit sums of a window are one LONG, the second sum modulo 2**31 on
    top; a stream gives their number, least, greatest and XOR.
    """
    from ..functions.checksums import rolling, rule_table

    values = rule_table() if table is None else table

    def kernel(data: np.ndarray):  # noqa: ANN202
        a, s = rolling(data, size, 32, values)
        if not len(a):
            return [], [], [], []
        both = (a | (s & np.uint64(0x7FFFFFFF)) << np.uint64(32)).astype(np.int64)
        return [len(both)], [both.min()], [both.max()], [np.bitwise_xor.reduce(both)]

    return _per_stream(streams, kernel, [("windows", "long"), ("low", "long"), ("high", "long"), ("check", "long")])


def packed(content: Column, tag: str) -> Column:
    """A content under a compressor by tag."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([codecs.compress(tag, v.as_py()) if v.is_valid else None for v in values], pa.binary())

    return F.arrow_udf(run, BinaryType())(content)


def unpacked(content: Column, size: Column, tag: str) -> Column:
    """The content that :func:`packed` took, of a known size."""

    def run(values: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([codecs.decompress(tag, v.as_py(), n.as_py()) if v.is_valid else None for v, n in zip(values, sizes, strict=True)], pa.binary())

    return F.arrow_udf(run, BinaryType())(content, size)


def packed_varint(value: Column) -> Column:
    """A LONG as variable-length bytes."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([codecs.pack_varint(v.as_py()) if v.is_valid else None for v in values], pa.binary())

    return F.arrow_udf(run, BinaryType())(value)


def unpacked_varint(value: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([codecs.Reader(v.as_py()).varint() if v.is_valid else None for v in values], pa.int64())

    return F.arrow_udf(run, LongType())(value)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Equal bytes at the start of two binaries."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([kernels.common_prefix(kernels.as_array(i.as_py()), kernels.as_array(j.as_py())) for i, j in zip(x, y, strict=True)], pa.int64())

    return F.arrow_udf(run, LongType())(a, b)


def container_kind(content: Column) -> Column:
    """The kind of a patch container by its tag, null for none."""
    from pyspark.sql.types import StringType

    from ..functions import formats

    def run(values: pa.Array) -> pa.Array:
        return pa.array([formats.sniff(v.as_py() or b"") for v in values], pa.string())

    return F.arrow_udf(run, StringType())(content)


def container_info(content: Column) -> Column:
    """Struct (kind, packing, old_size, new_size) of the head of a container."""
    from pyspark.sql.types import StringType

    from ..functions import formats

    def run(values: pa.Array) -> pa.Array:
        found = [formats.info(v.as_py()) for v in values]
        columns = [pa.array([f.kind for f in found], pa.string()), pa.array([f.compress for f in found], pa.string()), pa.array([f.old_size for f in found], pa.int64()), pa.array([f.new_size for f in found], pa.int64())]
        return pa.StructArray.from_arrays(columns, ["kind", "packing", "old_size", "new_size"])

    kinds = [("kind", StringType()), ("packing", StringType()), ("old_size", LongType()), ("new_size", LongType())]
    return F.arrow_udf(run, StructType([StructField(*k) for k in kinds]))(content)
