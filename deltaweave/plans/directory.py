"""Directory diffs: pair equal files, delta the rest, verify and rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks, files, pairs
from ..operators.tables import written


def choose_bases(new: DataFrame, old: DataFrame, size: int = 1024) -> DataFrame:
    """(path, base) of new files: the old file of the same path, else the one that
    shares most distinct blocks (the least path on a tie), else null.

    Blocks that many old files hold are counted for the least of them only, so
    a block's files never become pairs of each other.
    """
    own = new.select("path").join(old.select("path"), "path").select("path", F.col("path").alias("base"))
    rest = new.join(own, "path", "left_anti")
    signed = lambda t: blocks.signatures(t.select(F.col("path").alias("stream_id"), "content"), size).select("stream_id", "strong").distinct()
    table = signed(old).groupBy("strong").agg(F.min("stream_id").alias("base"))
    votes = signed(rest).join(table, "strong").groupBy("stream_id", "base").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("stream_id").orderBy(F.desc("shared"), "base")
    best = votes.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(F.col("stream_id").alias("path"), "base")
    return own.unionByName(rest.select("path").join(best, "path", "left"))


def dir_diff(new: DataFrame, old: DataFrame, kind: str = "steps", packing: str = "zlib") -> DataFrame:
    """(path, action, base, diff, new_size, digest) for each new file.

    ``action`` is copy (the base has the same bytes) or delta.  Files are rows
    (path, content).  Pairs of paths and the diff, which every use reads more than
    once, are written.
    """
    same = written(files.same_files(new, old).select(F.col("new_path").alias("path"), F.col("old_path").alias("base")), "same")
    digests = files.with_digest(new).select("path", "digest", F.col("size").alias("new_size"))
    rest = new.join(same, "path", "left_anti")
    based = choose_bases(rest, old).join(old.select(F.col("path").alias("base"), F.col("content").alias("old")), "base", "left")
    work = rest.join(based, "path").select(F.col("path").alias("stream_id"), "old", F.col("content").alias("new"))
    made = pairs.diff(work, kind, packing).select(F.col("stream_id").alias("path"), "diff")
    deltas = based.select("path", "base").join(made, "path")
    none = F.lit(None)
    rows = same.select("path", F.lit("copy").alias("action"), "base", none.cast("binary").alias("diff"))
    rows = rows.unionByName(deltas.select("path", F.lit("delta").alias("action"), "base", "diff"))
    return written(rows.join(digests, "path"), "changes")


def dir_patch(changes: DataFrame, old: DataFrame) -> DataFrame:
    """(path, content, ok) of the new files; ``ok`` tells if the digest matches."""
    based = changes.join(old.select(F.col("path").alias("base"), F.col("content").alias("old")), "base", "left")
    work = based.where("action = 'delta'").select(F.col("path").alias("stream_id"), "old", "diff", "new_size")
    made = pairs.patch(work).select(F.col("stream_id").alias("path"), F.col("made").alias("content"))
    copied = based.where("action = 'copy'").select("path", F.col("old").alias("content"))
    out = made.unionByName(copied).join(changes.select("path", "digest"), "path")
    return out.select("path", "content", (F.sha2("content", 256) == F.col("digest")).alias("ok"))


def removed(new: DataFrame, old: DataFrame) -> DataFrame:
    """The paths of old files that are in no new place."""
    return old.select("path").join(new.select("path"), "path", "left_anti")


def summary(changes: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """One row: files on both sides, copies and their bytes, deltas, diff bytes."""
    copy = F.col("action") == "copy"
    found = changes.agg(
        F.count_if(copy).alias("copies"),
        F.coalesce(F.sum(F.when(copy, F.col("new_size"))), F.lit(0)).cast("long").alias("copied_bytes"),
        F.count_if(~copy).alias("deltas"),
        F.coalesce(F.sum(F.octet_length("diff")), F.lit(0)).cast("long").alias("diff_bytes"),
    )
    counts = new.select(F.lit("new_files").alias("side")).unionByName(old.select(F.lit("old_files").alias("side")))
    sides = counts.groupBy().pivot("side", ["new_files", "old_files"]).count()
    return sides.withColumn("k", F.lit(1)).join(found.withColumn("k", F.lit(1)), "k").drop("k")
