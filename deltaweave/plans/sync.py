"""Synchronisation by block signatures: publish, match, plan, fetch, rebuild, check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums, formats, kernels
from ..operators import blocks, covers, pairs
from ..operators.tables import parts, written


def publish(streams: DataFrame, size: int = 2048, packing: str = "zlib") -> tuple[DataFrame, DataFrame]:
    """(signatures, payload) of new streams (stream_id, content).

    Signatures have one row a block with its strong hash and, where an earlier
    block is equal, that block; payload has the bytes, packed where that is
    shorter.  Equal blocks are published once.  Signatures are what a publisher
    keeps: they are written once and read by every step behind.
    """
    from ..operators.bytes import packed

    order = Window.partitionBy("stream_id", "strong").orderBy("block_index")
    signed = written(blocks.signatures(streams, size).withColumn("same_index", F.lag("block_index").over(order)), "signatures")
    same = signed.where("same_index IS NOT NULL")
    body = blocks.split_blocks(streams, size).join(same, ["stream_id", "block_index"], "left_anti")
    body = body.withColumn("size", F.octet_length("block").cast("long")).withColumn("zipped", packed(F.col("block"), packing))
    shorter = F.octet_length("zipped") < F.col("size")
    payload = body.select("stream_id", "block_index", "size", F.when(shorter, F.lit(packing)).otherwise("").alias("packing"), F.when(shorter, F.col("zipped")).otherwise(F.col("block")).alias("bytes"))
    return signed, payload


def positions(old: DataFrame, new: DataFrame, size: int = 2048) -> DataFrame:
    """Sync positions of the whole blocks of new streams in old ones."""
    both = old.select("stream_id", F.col("content").alias("old")).join(new.select("stream_id", F.col("content").alias("new")), "stream_id")
    return pairs.sync_positions(both, size)


def fetch(needed: DataFrame, signed: DataFrame, payload: DataFrame, packing: str = "zlib") -> DataFrame:
    """(stream_id, block_index, bytes) of needed blocks, unpacked; ``packing`` is
    the compressor that they were published with.

    A block that equals an earlier one is read from the block that was
    published, the first of its hash.
    """
    from ..operators.bytes import unpacked

    origin = signed.groupBy("stream_id", "strong").agg(F.min("block_index").alias("origin"))
    wanted = needed.select("stream_id", "block_index").join(signed.select("stream_id", "block_index", "strong"), ["stream_id", "block_index"]).join(origin, ["stream_id", "strong"])
    got = wanted.join(payload.withColumnRenamed("block_index", "origin"), ["stream_id", "origin"])
    mine = F.col("packing") == packing
    bytes_ = F.when(mine, unpacked(F.when(mine, F.col("bytes")), F.col("size"), packing)).otherwise(F.col("bytes")) if packing else F.col("bytes")
    return got.select("stream_id", "block_index", bytes_.alias("bytes"))


def resume(needed: DataFrame, present: DataFrame) -> DataFrame:
    """The needed blocks that an interrupted run has not brought yet."""
    return needed.join(present.select("stream_id", "block_index"), ["stream_id", "block_index"], "left_anti")


def rebuilt_blocks(old: DataFrame, located: DataFrame, fetched: DataFrame, signed: DataFrame, size: int = 2048) -> DataFrame:
    """(stream_id, block_index, bytes, ok): each block of new, from old or fetched.

    Old streams are read once a row: the places of a stream (numbers) are
    gathered beside its content.  Blocks stay rows; every one is checked against
    its strong hash, and nothing brings a whole stream together.
    """
    local = located.where("old_pos IS NOT NULL").select("stream_id", "block_index", "old_pos", "length")
    gathered = local.groupBy("stream_id").agg(F.collect_list(F.struct("block_index", "old_pos", "length")).alias("list"))
    read = gathered.join(old.select("stream_id", "content"), "stream_id")
    cut = F.transform("list", lambda b: F.struct(b["block_index"].alias("block_index"), F.substring("content", (b["old_pos"] + 1).cast("int"), b["length"].cast("int")).alias("bytes")))
    own = read.select("stream_id", F.explode(cut).alias("b")).select("stream_id", "b.block_index", "b.bytes")
    every = own.unionByName(fetched.select("stream_id", "block_index", "bytes"))
    checked = signed.select("stream_id", "block_index", "strong").join(every, ["stream_id", "block_index"], "left")
    good = F.coalesce(F.md5(blocks.padded(F.col("bytes"), size)) == F.col("strong"), F.lit(False))
    return checked.select("stream_id", "block_index", "bytes", good.alias("ok"))


def rebuild(old: DataFrame, located: DataFrame, fetched: DataFrame, signed: DataFrame, size: int = 2048) -> DataFrame:
    """(stream_id, content, ok): the blocks of :func:`rebuilt_blocks` put together,
    for streams that fit a row."""
    checked = rebuilt_blocks(old, located, fetched, signed, size)
    parts = checked.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("block_index", F.hex("bytes").alias("hex")))).alias("parts"), F.bool_and("ok").alias("ok"))
    return parts.select("stream_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")).alias("content"), "ok")


def synchronise(old: DataFrame, new: DataFrame, size: int = 2048, packing: str = "zlib") -> DataFrame:
    """Publish, match, fetch and rebuild; (stream_id, ok, blocks, need_blocks).

    ``ok`` tells that every block has its published hash and that the file check
    over all of them is that of new.
    """
    signed, payload = publish(new, size, packing)
    located = written(positions(old, new, size), "positions")
    tails = signed.join(located.select("stream_id", "block_index"), ["stream_id", "block_index"], "left_anti")
    needed = covers.needed_blocks(located).select("stream_id", "block_index").unionByName(tails.select("stream_id", "block_index"))
    made = rebuilt_blocks(old, located, fetch(needed, signed, payload, packing), signed, size)
    again = made.select("stream_id", "block_index", "ok", F.md5(blocks.padded(F.col("bytes"), size)).alias("strong"))
    checks = blocks.xor_check(again, F.bool_and("ok").alias("ok")).select("stream_id", F.col("check").alias("made"), "ok")
    wanted = blocks.xor_check(signed).select("stream_id", "blocks", "check")
    missing = needed.groupBy("stream_id").agg(F.count(F.lit(1)).alias("need_blocks"))
    return (
        wanted.join(checks, "stream_id")
        .join(missing, "stream_id", "left")
        .select("stream_id", (F.col("ok") & (F.col("made") == F.col("check"))).alias("ok"), "blocks", F.coalesce("need_blocks", F.lit(0).cast("long")).alias("need_blocks"))
    )


def local_diff(old: DataFrame, new: DataFrame, size: int = 2048, packing: str = "zlib") -> tuple[DataFrame, DataFrame]:
    """(codes, blocks): a sync diff as two tables, made where old and new meet.

    ``codes`` has (stream_id, at, kind, value, blocks), the coded places of whole
    blocks; ``blocks`` has (stream_id, block_index, size, packing, bytes) of the
    blocks that old lacks and of short last ones, equal blocks once.
    """
    signed, payload = publish(new, size, packing)
    located = written(positions(old, new, size), "positions")
    held = located.where("old_pos IS NOT NULL").select("stream_id", "block_index")
    wanted = signed.join(held, ["stream_id", "block_index"], "left_anti").select("stream_id", "strong").distinct()
    first = signed.join(wanted, ["stream_id", "strong"]).groupBy("stream_id", "strong").agg(F.min("block_index").alias("block_index"))
    return covers.position_codes(located), payload.join(first.select("stream_id", "block_index"), ["stream_id", "block_index"], "left_semi")


def local_patch(old: DataFrame, codes: DataFrame, given: DataFrame, signed: DataFrame, size: int = 2048, packing: str = "zlib") -> DataFrame:
    """(stream_id, block_index, bytes, ok): new from old and a sync diff, by block."""
    located = covers.decode_positions(codes, size)
    held = located.where("old_pos IS NOT NULL").select("stream_id", "block_index")
    needed = signed.join(held, ["stream_id", "block_index"], "left_anti").select("stream_id", "block_index")
    return rebuilt_blocks(old, located, fetch(needed, signed, given, packing), signed, size)


def rolling_signatures(streams: DataFrame, size: int) -> DataFrame:
    """(stream_id, old_size, block_index, key, strong) of the whole blocks; one
    row without a block for a stream that has none.

    ``key`` has both rolling sums in one LONG, ``strong`` is the MD5 digest.
    """
    sized = streams.select("stream_id", F.octet_length("content").cast("long").alias("old_size"))
    cut = blocks.split_blocks(streams, size, tail=False)
    sums = cut.select("stream_id", "block_index", checksums.fadler64(F.col("block")).alias("sums"), F.md5("block").alias("strong"))
    key = F.col("sums.a").bitwiseOR(F.expr("shiftleft(sums.s, 32)"))
    return sized.join(sums.select("stream_id", "block_index", key.alias("key"), "strong"), "stream_id", "left")


def diff_by_signature(signed: DataFrame, new: DataFrame, size: int, packing: str = "zlib") -> DataFrame:
    """(stream_id, diff, new_size) made without the bytes of old.

    Covers are equal bytes, so the difference is zero throughout.  Signatures of
    one stream are gathered beside its content: some forty bytes a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            made, sizes = [], []
            for content, old_size, found in zip(*part.columns[1:], strict=True):
                data, old = kernels.as_array(content.as_py()), old_size.as_py() or 0
                blocks_, keys, strong = ([] if found.values is None else found.values.field(k) for k in range(3))
                keys = np.asarray(keys, np.int64).view(np.uint64)
                covers_ = kernels.signature_covers(np.asarray(blocks_, np.int64).tolist(), keys, [v.as_py() for v in strong], old, data, size)
                made.append(formats.encode_literal_steps(data, old, covers_, packing))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary()), pa.array(sizes, pa.int64())], ["stream_id", "diff", "new_size"])

    lists = signed.groupBy("stream_id").agg(F.first("old_size").alias("old_size"), F.collect_list(F.when(F.col("block_index").isNotNull(), F.struct("block_index", "key", "strong"))).alias("list"))
    joined = new.select("stream_id", "content").join(lists, "stream_id", "left")
    kind = new.schema["stream_id"].dataType.simpleString()
    return joined.select("stream_id", "content", "old_size", "list").mapInArrow(run, f"stream_id {kind}, diff binary, new_size long")
