"""SimHash near-dedup by a similarity: five-word shingles, Jaccard 0.8 or more.

The operator of :mod:`simhash_dedup` for a bound on similarity instead of one on
bits.  A text becomes the set of 64-bit hashes of its runs of five words (a
shorter text is one run) and their SimHash fingerprint.  Two texts are linked if
their sets have a Jaccard similarity of 0.8 or more.

Fingerprints that meet by deletion variants give candidates, which are verified
on the whole sets.  They cannot give all: texts of that similarity may differ in
some seventeen of 64 bits.  The rest is exact: under any total order of the
shingles, what two similar sets share lies in the first n - ceil(0.8 n) + 4 of
each but for what the one whose prefix ends first has behind it.  So these
prefixes are grouped by shingle, a pair must meet as often as that asks (four
times at least), and what is left is bounded by size, place and a bitmap of each
set and then verified.  The order puts shingles that are frequent in a sample
last; it decides the work, not the result.

Equal sets are folded first.  Groups yield pairs in two rounds: stars, beside
the candidates by fingerprint, then, once these are verified and joined, all
pairs whose members are still in different components.  The meetings of a pair
are counted over the small groups.  A large group does not become its pairs: its
rows carry bitmaps, so that it yields stars around leaders, then only pairs whose
bitmaps agree; a pair that meets in a large group needs no count.

Defined cases: a null or empty text, or one of white space only, has the empty
set, and all of these are alike; else as in :mod:`simhash_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import few, fresh, gathered, heaps_give_back, keep, leaving_nothing, slices, small_batches
from .simhash_dedup import components_of, fingerprint_from, near_links, one_of_each, shingle_hashes

SHINGLE_WORDS = 5
#: The least similarity as a fraction, so that it is compared in whole numbers.
SHARED, OF = 4, 5
#: Sets in the sample that orders the shingles, and the frequent ones kept of it.
SAMPLE_SETS, FREQUENT = 16_384, 50_000
_ROWS = 1 << 16
_STRIP = 1 << 20
_BITS = 1024
#: Meetings of a similar pair at least, and members of a group that yields its pairs.
_MEETS, _SMALL = 4, 48


def shingles_of(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of one UTF-8 text."""
    parts = [np.unique(run) for run in shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= SHARED * (len(a) + len(b) - shared)


def bitmap_of(shingles: np.ndarray) -> bytes:
    """Parities of the shingles counted by their lowest bits, two bits or more a shingle."""
    size = max(_BITS, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else _BITS
    counts = np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The differing bits of two bitmaps; the longer is folded to the other's size."""
    x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints, values = [], []
        for text in batch.column(2).cast(pa.binary()):
            runs = list(shingle_hashes(text.as_py(), SHINGLE_WORDS))
            prints.append(fingerprint_from(runs))
            values.append(np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64))
        fps = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in values], np.uint64).view(np.int64)
        sizes = np.array([len(v) for v in values], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(values).view(np.int64)))
        numbers = [pa.array(c, pa.int64()) for c in (fps, np.array(prints, np.uint64).view(np.int64), sizes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array([bitmap_of(v) for v in values], pa.binary()), lists], ["doc_id", "mark", "fp", "print", "n", "bits", "shingles"])


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as arrays of unsigned numbers."""
    flat = column.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy())
    return (flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else iter(())


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of ``sets`` (fp, shingles) repeats, sorted, and their ranks."""
    n = sets.count()
    million = 1_000_000
    share = min(million, int(np.ceil(million * SAMPLE_SETS / max(n, 1))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten()], ["shingle"])

    sample = sets.where(F.pmod(F.xxhash64("fp"), F.lit(million)) < share).select("shingles")
    counted = sample.mapInArrow(leaving_nothing(each), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    values = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(rows) - np.arange(len(rows)))[order]


def _prefix(n: np.ndarray) -> np.ndarray:
    """The shingles in the prefix of a set of ``n``."""
    return np.minimum(n, n - -(-SHARED * n // OF) + _MEETS)


def _prefixes(sets: DataFrame) -> DataFrame:
    """(key, fp, n, at) of the shingles in each set's prefix."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent_shingles(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = shared.value
        for batch in slices(batches):
            rows = []
            for fp, values in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), strict=True):
                n = len(values)
                if not n:
                    continue
                if len(often):
                    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                    values = values[np.argsort(np.where(often[at] == values, rank[at], 0), kind="stable")]
                first = values[: _prefix(n)]
                m = len(first)
                rows.append((first.view(np.int64), np.full(m, fp, np.int64), np.full(m, n, np.int32), np.arange(m, dtype=np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["key", "fp", "n", "at"])

    return sets.select("fp", "shingles").mapInArrow(leaving_nothing(prefixes), "key long, fp long, n int, at int")


def _reach(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets that meet at these places can share enough."""
    most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
    return (SHARED + OF) * most >= SHARED * (n[i] + n[j])


def _needed(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The meetings that a similar pair of these sizes has in its prefixes.

    Of the two prefixes one ends first in the order of the shingles.  Whatever
    the sets share up to there is in both.
    """
    behind = n - _prefix(n)
    return -(-SHARED * (n[i] + n[j]) // (SHARED + OF)) - np.maximum(behind[i], behind[j])


def _group_pairs(root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different roots in one group, in strips."""
    values, counts = np.unique(root, return_counts=True)
    if len(values) == 1:
        return
    # the members of the commonest root meet the others only
    most = root == values[counts.argmax()]
    size, rows = len(root), np.flatnonzero(~most)
    step = max(1, _STRIP // size)
    for low in range(0, len(rows), step):
        strip = rows[low : low + step]
        i, j = np.nonzero((root[strip, None] != root[None, :]) & (most[None, :] | (strip[:, None] < np.arange(size))))
        yield strip[i], j


def _alike(n: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the bitmaps leave it open that the sets are similar."""
    differ = np.zeros(len(i), np.int64)
    for word in maps.T:
        differ += np.bitwise_count(word[i] ^ word[j])
    return (OF + SHARED) * differ <= (OF - SHARED) * (n[i] + n[j])


def _leader_pairs(n: np.ndarray, at: np.ndarray, maps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join most of a large group: a member beside no leader yet leads;
    it is paired with all others beside no leader, and with one beside each leader."""
    led = np.full(len(n), -1)
    for first in range(len(n)):
        if led[first] >= 0:
            continue
        j = np.flatnonzero(_reach(n, at, np.full(len(n), first), np.arange(len(n))))
        j = j[_alike(n, maps, np.full(len(j), first), j)]
        j = j[j != first]
        _, one = np.unique(led[j], return_index=True)
        one = one[led[j[one]] >= 0]
        free = j[led[j] < 0]
        yield np.full(len(free) + len(one), first), np.r_[free, j[one]]
        led[free] = led[first] = first


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, bits) with the bitmaps folded to the least size."""
    for batch in batches:
        maps = [np.bitwise_xor.reduce(np.frombuffer(x.as_py(), np.uint64).reshape(-1, _BITS // 64), axis=0).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["fp", "bits"])


def _words(column: pa.Array) -> np.ndarray:
    """Numbers, or bitmaps of the least size as a row of words each."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy().astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _BITS // 64)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of a partition sorted by its first one, cut between groups."""
    held: list[list[np.ndarray]] = []
    for batch in gathered(batches):
        columns = [_words(c) for c in batch.columns]
        if held and columns[0][-1] == held[0][0][0]:
            held.append(columns)  # one group throughout
            continue
        columns = [np.concatenate(c) for c in zip(*held, columns, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [[c[last:] for c in columns]]
        if last:
            yield [c[:last] for c in columns]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where the groups of sorted keys begin, and the end."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, fp, n, at) whose key is in two sets or more, and in how many."""
    for columns in _whole_groups(batches):
        sizes = np.diff(_cuts(columns[0]))
        columns.append(np.repeat(sizes, sizes))
        often = columns[-1] > 1
        yield pa.RecordBatch.from_arrays([pa.array(c[often]) for c in columns], ["key", "fp", "n", "at", "sets"])


def _put_out(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Pairs with the meetings they need, the smaller first, in batches."""
    held, total = [], 0
    for a, b, needed in parts:
        held.append((np.minimum(a, b), np.maximum(a, b), needed))
        total += len(a)
        if total > _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b", "needed"])
            held, total = [], 0
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b", "needed"])


def _small_pairs(batches: Iterator[pa.RecordBatch], rooted: bool) -> Iterator[pa.RecordBatch]:
    """Meetings (a, b, needed) in the small groups of one partition sorted by key: stars, or of different roots."""

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for keys, fps, n, at, *root in _whole_groups(batches):
            cut = _cuts(keys)
            sizes = np.diff(cut)
            start, place = np.repeat(cut[:-1], sizes), np.arange(len(keys)) - np.repeat(cut[:-1], sizes)
            for back in range(1, int(sizes.max())):
                j = np.flatnonzero(place >= back)
                i = j - back if rooted else start[j]
                if rooted:
                    apart = root[0][i] != root[0][j]
                    i, j = i[apart], j[apart]
                good = _reach(n, at, i, j)
                i, j = i[good], j[good]
                yield fps[i], fps[j], _needed(n, i, j)
                if not rooted:
                    break

    yield from _put_out(parts())


def _large_pairs(batches: Iterator[pa.RecordBatch], rooted: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, needed) of the large groups of one partition sorted by key, by bitmap."""

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for keys, *columns in _whole_groups(batches):
            cut = _cuts(keys)
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                fps, n, at, maps, *root = (c[low:high] for c in columns)
                for i, j in _group_pairs(root[0]) if rooted else _leader_pairs(n, at, maps):
                    good = _reach(n, at, i, j)
                    i, j = i[good], j[good]
                    good = _alike(n, maps, i, j)
                    i, j = i[good], j[good]
                    yield fps[i], fps[j], np.zeros(len(i), np.int64)

    yield from _put_out(parts())


def _group_candidates(small: DataFrame, large: DataFrame, rooted: bool) -> DataFrame:
    """Candidate pairs (a, b) of all groups, those of small ones by their meetings."""
    small, large = (t.repartition("key").sortWithinPartitions("key", "n", "fp") for t in (small, large))
    met = small.mapInArrow(leaving_nothing(lambda x: _small_pairs(x, rooted)), "a long, b long, needed long")
    # a star leaves out meetings, and what it does not give comes in the next round
    needed = F.max("needed") if rooted else F.lit(2)
    often = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("meetings"), needed.alias("needed")).where("meetings >= needed")
    alike = large.mapInArrow(leaving_nothing(lambda x: _large_pairs(x, rooted)), "a long, b long, needed long")
    return often.select("a", "b").unionByName(alike.select("a", "b")).distinct()


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose bitmaps do not rule out that they are similar.

    The differing bits of two bitmaps are at most the differing shingles.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, x, y = (c.to_pylist() for c in batch.columns[2:])
            differ = np.array([differing(*pair) for pair in zip(x, y, strict=True)])
            good = (OF + SHARED) * differ <= (OF - SHARED) * np.array(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    nodes = few(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "nodes")
    wanted = keep(sets.join(nodes, "fp", "left_semi").select("fp", "n", "bits"), "bits")
    left = wanted.select(F.col("fp").alias("a"), F.col("bits").alias("x"), "n")
    right = wanted.select(F.col("fp").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n") + F.col("m")).alias("n"), "x", "y")
    return keep(met.mapInArrow(leaving_nothing(check), "a long, b long"), "close")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar."""
    heaps_give_back(sets.sparkSession)
    close = _close(pairs, sets)
    nodes = few(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "nodes")
    wanted = sets.join(nodes, "fp", "left_semi").select("fp", "n", "shingles")
    left = wanted.select(F.col("fp").alias("a"), "n", F.col("shingles").alias("x"))
    right = wanted.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return keep(close.join(left, "a").join(right, "b").where(OF * shared >= SHARED * (F.col("n") + F.col("m") - shared)).select("a", "b"), "verified")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets whose SimHash fingerprints are near: a
    spanning choice of the links between fingerprints, and of one fingerprint."""
    first = keep(sets.groupBy("print").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("sets")), "fingerprints")
    again = sets.select("fp", "print").join(first.where("sets > 1"), "print").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = keep(near_links(first.select(F.col("print").alias("fp"))), "near")
    ends = near.join(few(first.select(F.col("print").alias("a"), F.col("first").alias("x")).join(near.select("a").distinct(), "a", "left_semi"), "left"), "a")
    ends = ends.join(few(first.select(F.col("print").alias("b"), F.col("first").alias("y")).join(near.select("b").distinct(), "b", "left_semi"), "right"), "b")
    every = ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(again)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all similar sets of ``sets`` (distinct fp, print, n, bits, shingles)."""
    spark = sets.sparkSession
    small_batches(spark)
    prefixes = _prefixes(sets).repartition("key").sortWithinPartitions("key")
    index = keep(prefixes.mapInArrow(leaving_nothing(_met), "key long, fp long, n long, at long, sets long"), "prefixes")
    heaps_give_back(spark)
    small = index.where(F.col("sets") <= _SMALL).drop("sets")
    large = index.where(F.col("sets") > _SMALL).drop("sets")
    members = few(large.select("fp").distinct(), "members")
    maps = sets.select("fp", "bits").join(members, "fp", "left_semi").mapInArrow(leaving_nothing(_folded), "fp long, bits binary")
    large = keep(large.join(maps, "fp").select("key", "fp", "n", "at", "bits"), "large")
    first = keep(_group_candidates(small, large, False).unionByName(_by_fingerprint(sets)).distinct(), "pairs")
    links = _verified(first, sets)
    roots = few(connected_components(links).withColumnRenamed("node", "fp"), "roots")
    heaps_give_back(spark)
    # a lone set stands for itself; groups of one component have no pairs left
    rooted = (t.join(roots, "fp", "left").select(*t.columns, F.coalesce("root", "fp").alias("root")) for t in (small, large))
    rest = _group_candidates(*rooted, True).join(first, ["a", "b"], "left_anti")
    return links.unionByName(_verified(keep(rest, "pairs"), sets))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of similar texts, chosen as in :func:`simhash_dedup.drop_near_duplicates`."""
    mark = fresh(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    small_batches(docs.sparkSession)
    source = marked.select(F.col("doc_id").cast("long"), F.col(mark).alias("mark"), F.col("text"))
    prints = source.mapInArrow(leaving_nothing(_sets), "doc_id long, mark long, fp long, print long, n long, bits binary, shingles array<bigint>")
    prints = keep(prints.withColumn("row", F.monotonically_increasing_id()), "sets")

    def links(classes: DataFrame) -> DataFrame:
        copied = prints.groupBy("fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        again = few(prints.select("fp", "row").join(copied, "fp").where("row <> first").select("row"), "again")
        return similar_links(prints.join(again, "row", "left_anti").select("fp", "print", "n", "bits", "shingles"))

    return one_of_each(docs, prints.select("doc_id", "mark", "fp"), components_of(prints.select("doc_id", "fp"), links))


__all__ = ["drop_similar", "shingles_of", "similar", "similar_links"]
