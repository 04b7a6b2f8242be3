"""Directory operators on manifests: rows (path, is_dir, size, content or digest)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bytes of a ref stream by which places and files meet.
BUCKET = 1 << 20


def ignore_pattern(rules: str) -> str:
    """A regular expression for ``#``-separated path globs.

    ``*`` matches within one path part, a final ``/`` means a directory, ``#:``
    and ``*:`` are the plain characters, ``**`` is refused, and a lone ``*``
    matches everything.  A rule matches whole path parts anywhere in a path.
    """
    parts, rule, at = [], [], 0
    while at <= len(rules):
        two, one = rules[at : at + 2], rules[at : at + 1]
        if two in ("#:", "*:"):
            rule.append(re.escape(two[0]))
            at += 2
        elif two == "**":
            raise ValueError("** is not a rule")
        elif one in ("#", ""):
            if rule:
                parts.append("".join(rule))
            rule = []
            at += 1
        else:
            rule.append("[^/]*" if one == "*" else re.escape(one))
            at += 1
    if not parts:
        return "$^"
    out = []
    for part in parts:
        if part == "[^/]*":
            return ""
        out.append(f"(?:^|/){part[:-1]}/" if part.endswith("/") else f"(?:^|/){part}(?:/|$)")
    return "|".join(out)


def ignored(path: Column, rules: str) -> Column:
    """Whether a path falls under the rules; back-slashes count as slashes."""
    return F.translate(path, "\\", "/").rlike(ignore_pattern(rules))


def with_digest(files: DataFrame) -> DataFrame:
    """Files with size and SHA-256 of their contents."""
    return files.withColumn("size", F.octet_length("content").cast("long")).withColumn("digest", F.sha2("content", 256))


def same_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_path, old_path): new files whose content an old file has.

    An old file of the same path comes first, else the least path.  Empty files
    never pair.  Old files of equal content are folded to their least path
    before the join, so groups of copies do not multiply.
    """
    keys = ["size", "digest"]
    sized = lambda t: with_digest(t).where("size > 0").select("path", *keys)
    left, right = sized(new), sized(old)
    least = right.groupBy(*keys).agg(F.min("path").alias("old_path"))
    own = right.select(*keys, "path", F.col("path").alias("own_path"))
    joined = left.join(least, keys).join(own, [*keys, "path"], "left")
    return joined.select(F.col("path").alias("new_path"), F.coalesce("own_path", "old_path").alias("old_path"))


def leftovers(files: DataFrame, used: Column, pairs: DataFrame) -> DataFrame:
    """The files that no pair uses."""
    return files.join(pairs.select(used.alias("path")).distinct(), "path", "left_anti")


def ref_stream(files: DataFrame, order_by: str = "path", align: int = 1) -> DataFrame:
    """(path, size, begin, end) of files laid end to end, each start aligned."""
    order = Window.orderBy(order_by)
    room = F.ceil(F.col("size") / align).cast("long") * align
    begin = F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, 0)) - room
    return files.select("path", "size", begin.alias("begin"), (begin + F.col("size")).alias("end"))


def running_total(rows: DataFrame, order_by: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before, without one task for all.

    Rows are dealt to partitions by range and written once with the number of
    their partition: the totals of partitions (one row each) and the places
    inside them must come from one and the same dealing.
    """
    dealt = written(rows.repartitionByRange(order_by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    before = totals.select("_part", (F.sum("_total").over(upto) - F.col("_total")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.sum(value).over(inside) - F.col(value))
    return placed.drop("_part", "_before")


def ref_stream_by_range(files: DataFrame, order_by: str = "path", align: int = 1) -> DataFrame:
    """The layout of :func:`ref_stream` without one task for all files."""
    room = F.ceil(F.col("size") / align).cast("long") * align
    placed = running_total(files.select("path", "size", room.alias("room"), F.col(order_by).alias("place")), "place", "room", "begin")
    return placed.select("path", "size", "begin", (F.col("begin") + F.col("size")).alias("end"))


def numbered(rows: DataFrame, order_by: str) -> DataFrame:
    """``rows`` with ``index``, their place from 0 in the order of a column."""
    counted = running_total(rows.withColumn("_one", F.lit(1).cast("long")), order_by, "_one", "index")
    return counted.drop("_one")


def index_deltas(indexes: DataFrame, value: str) -> DataFrame:
    """(index, delta) of a numbered list: each value less the one before.

    The value before the first counts as -1, and a following value gives its
    distance less one, so an ascending list has deltas of 0 and up.  Neighbours
    meet by an equality join on their numbers.
    """
    before = indexes.select((F.col("index") + 1).alias("index"), F.col(value).alias("before"))
    return indexes.join(before, "index", "left").select("index", (F.col(value) - F.coalesce("before", F.lit(-1)) - 1).alias("delta"))


def same_pair_deltas(pairs: DataFrame) -> DataFrame:
    """(index, new_delta, old_delta) of pairs (new_index, old_index) in order of new.

    The new index counts from the one before less one, the old index is a signed
    distance to the old index before; both start from -1.
    """
    listed = numbered(pairs, "new_index")
    before = listed.select((F.col("index") + 1).alias("index"), F.col("new_index").alias("last_new"), F.col("old_index").alias("last_old"))
    last = lambda c: F.coalesce(c, F.lit(-1))
    return listed.join(before, "index", "left").select(
        "index",
        (F.col("new_index") - last("last_new") - 1).alias("new_delta"),
        (F.col("old_index") - last("last_old") - 1).alias("old_delta"),
    )


def combined_sums(sums: DataFrame, base: int, order_by: str = "path") -> DataFrame:
    """(a, s): the Adler sums of all files end to end, from the sums of each.

    ``sums`` has path, a, s and size.  With d = a - 1 of every file, a is
    1 + sum(d) and s is sum(s) + sum(size * (d of the files before)); partitions
    by range add up their own files and then meet as one row each.
    """
    whole = "decimal(38,0)"
    d = (F.col("a") - 1).cast(whole)
    parts = sums.select(F.col(order_by).alias("place"), d.alias("d"), F.col("s").cast(whole).alias("s"), F.col("size").cast(whole).alias("size")).repartitionByRange("place")
    parts = parts.withColumn("part", F.spark_partition_id())
    before = F.coalesce(F.sum("d").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(whole))
    own = parts.withColumn("e", (F.col("size") % base) * (before % base) % base).groupBy("part").agg(F.sum("d").alias("d"), (F.sum("s") + F.sum("e")).alias("s"), F.sum("size").alias("size"))
    upto = F.coalesce(F.sum("d").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(whole))
    placed = own.withColumn("e", (F.col("size") % base) * (upto % base) % base)
    total = placed.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("s") + F.col("e")), F.lit(0)).alias("s"))
    return total.select(F.pmod(F.col("d") + 1, F.lit(base)).cast("long").alias("a"), F.pmod("s", F.lit(base)).cast("long").alias("s"))


def at_positions(positions: DataFrame, layout: DataFrame) -> DataFrame:
    """(pos, path, offset): the file that holds a place of the ref stream.

    Files and places meet by buckets of 1 MiB, an equality join; padding and
    places behind the end have no file.
    """
    cells = F.explode(F.sequence(F.floor(F.col("begin") / BUCKET), F.floor((F.col("end") - 1) / BUCKET)))
    held = layout.where("size > 0").select("path", "begin", "end", cells.alias("cell"))
    asked = positions.select("pos", F.floor(F.col("pos") / BUCKET).alias("cell"))
    met = asked.join(held, "cell").where("pos >= begin AND pos < `end`")
    return met.select("pos", "path", (F.col("pos") - F.col("begin")).alias("offset"))


def split_output(stream: DataFrame, layout: DataFrame) -> DataFrame:
    """(path, offset, bytes) of a sequential output (pos, bytes) cut at files.

    Segments and files meet by buckets of 1 MiB, an equality join.
    """
    size = F.octet_length("bytes").cast("long")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor((b - 1) / BUCKET)))
    left = stream.where(size > 0).select("pos", "bytes", (F.col("pos") + size).alias("stop")).select("*", cells(F.col("pos"), F.col("stop")).alias("cell"))
    right = layout.where("size > 0").select("path", "begin", "end").select("*", cells(F.col("begin"), F.col("end")).alias("cell"))
    met = left.join(right, "cell").where("begin < stop AND `end` > pos")
    start, stop = F.greatest("pos", "begin"), F.least("stop", "end")
    met = met.where(F.col("cell") == F.floor(start / BUCKET))
    cut = F.substring("bytes", (start - F.col("pos") + 1).cast("int"), (stop - start).cast("int"))
    return met.select("path", (start - F.col("begin")).alias("offset"), cut.alias("bytes"))


def manifest_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed or same by digest."""
    a = new.select("path", F.col("digest").alias("new_digest"))
    b = old.select("path", F.col("digest").alias("old_digest"))
    joined = a.join(b, "path", "full_outer")
    change = (
        F.when(F.col("old_digest").isNull(), "added")
        .when(F.col("new_digest").isNull(), "removed")
        .when(F.col("new_digest") != F.col("old_digest"), "changed")
        .otherwise("same")
    )
    return joined.select("path", change.alias("change"))


def is_equal(new: DataFrame, old: DataFrame) -> bool:
    """Whether two manifests list the same paths with the same digests."""
    return not manifest_diff(new, old).where("change <> 'same'").take(1)
