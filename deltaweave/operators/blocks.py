"""Blocks of streams and their signatures.

A stream is a row ``(stream_id, content)``.  Blocks are cut inside the row and
only then become rows, so a long stream is copied once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_blocks(streams: DataFrame, size: int, tail: bool = True) -> DataFrame:
    """(stream_id, block_index, pos, block) of the aligned blocks of each stream.

    ``tail`` keeps a last block that is shorter.  A null content has no blocks.
    """
    length = F.octet_length("content")
    count = F.ceil(length / size) if tail else F.floor(length / size)
    at = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(at, lambda i: F.substring("content", i * size + 1, size))
    rows = streams.select("stream_id", F.posexplode(blocks).alias("block_index", "block"))
    index = F.col("block_index").cast("long")
    return rows.select("stream_id", index.alias("block_index"), (index * size).alias("pos"), "block")


def block_count(size: Column, block: int) -> Column:
    return F.ceil(size / block).cast("long")


def tail_size(size: Column, block: int) -> Column:
    """The length of the last block, zero for an empty stream."""
    return F.when(size > 0, F.pmod(size - 1, F.lit(block)) + 1).otherwise(F.lit(0)).cast("long")


def padded(block: Column, size: int) -> Column:
    """A block filled with zero bytes to ``size``, as a signature hashes a tail."""
    return F.unhex(F.rpad(F.hex(block), 2 * size, "0"))


def shifted_position(index: Column, size: Column, block: int) -> Column:
    """The place of a block where the last one is moved back to end the stream."""
    return F.least(index * block, size - block)


def signatures(streams: DataFrame, size: int) -> DataFrame:
    """(stream_id, block_index, pos, length, strong) with MD5 over padded blocks."""
    blocks = split_blocks(streams, size)
    return blocks.select("stream_id", "block_index", "pos", F.octet_length("block").cast("long").alias("length"), F.md5(padded(F.col("block"), size)).alias("strong"))


def earlier_same_blocks(signed: DataFrame) -> DataFrame:
    """(stream_id, block_index, same_index) of blocks equal to an earlier one.

    ``same_index`` is the nearest earlier block with the same hash.
    """
    order = Window.partitionBy("stream_id", "strong").orderBy("block_index")
    found = signed.withColumn("same_index", F.lag("block_index").over(order))
    return found.where("same_index IS NOT NULL").select("stream_id", "block_index", "same_index")


def shared_blocks(signed: DataFrame) -> DataFrame:
    """(strong, streams, blocks, first_stream) of blocks that several streams hold."""
    found = signed.groupBy("strong", "stream_id").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("strong").agg(F.count(F.lit(1)).alias("streams"), F.sum("n").alias("blocks"), F.min("stream_id").alias("first_stream"))
    return found.where("streams > 1")


def known_blocks(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of ``new`` whose strong hash any stream of ``old`` has.

    A semi-join on distinct keys in front of dearer matching; Spark adds a
    Bloom filter of its own where that pays.
    """
    return new.join(old.select("strong").distinct(), "strong", "left_semi")


def digest_order(signed: DataFrame, depth: int = 2) -> DataFrame:
    """(stream_id, block_index, place): the blocks of a stream by their digest, then
    by up to ``depth`` digests behind it, the later block first on a tie."""
    along = Window.partitionBy("stream_id").orderBy("block_index")
    ahead = [F.coalesce(F.lead("strong", k).over(along), F.lit("")).alias(f"ahead_{k}") for k in range(1, depth + 1)]
    keyed = signed.select("stream_id", "block_index", "strong", *ahead)
    order = Window.partitionBy("stream_id").orderBy("strong", *(f"ahead_{k}" for k in range(1, depth + 1)), F.desc("block_index"))
    return keyed.select("stream_id", "block_index", (F.row_number().over(order) - 1).cast("long").alias("place"))


def xor_check(signed: DataFrame, *more: Column) -> DataFrame:
    """(stream_id, blocks, check): an order-free check over numbered block hashes,
    and more aggregates of the blocks."""
    numbered = F.md5(F.concat_ws(":", "block_index", "strong"))
    part = F.conv(F.substring(numbered, 1, 15), 16, 10).cast("long")
    return signed.groupBy("stream_id").agg(F.count(F.lit(1)).alias("blocks"), F.bit_xor(part).alias("check"), *more)


def clash_counts(hashed: DataFrame, bits: list[int]) -> DataFrame:
    """(bits, windows, distinct_values, clashes) of a LONG hash cut to few bits.

    ``hashed`` has the hash of distinct contents in ``h``.
    """
    rows = hashed.select(F.explode(F.array(*map(F.lit, bits))).alias("bits"), "h")
    cut = F.col("h").bitwiseAND(F.expr("shiftleft(1L, bits) - 1"))
    counted = rows.select("bits", cut.alias("h")).groupBy("bits").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("h").alias("distinct_values"))
    return counted.withColumn("clashes", F.col("windows") - F.col("distinct_values"))
