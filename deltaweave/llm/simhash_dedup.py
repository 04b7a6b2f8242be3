"""SimHash near-duplicate detection by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints
differ in two bits or fewer, one of their segments differs in one bit at most,
so the two share one of the 2 x 32 segment variants in which a single bit is
replaced by a wildcard.  Variants are grouped by equality, and every link is
verified on the 64 bits.

Copies are folded first: everything after the fingerprints works on distinct
values.  A variant group never becomes all of its pairs; it yields a spanning
forest of its verified links, at most one edge less than its members.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other; a null ``doc_id`` takes part but
never names a component (``component_id`` is the smallest non-null id, null if
there is none); repeated rows stay repeated; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import connected_components
from .scratch import few, fresh, gathered, keep, leaving_nothing, small_batches

MAX_BITS = 2
SHINGLE_WORDS = 3
_CHUNK = 1 << 20
_BLOCK = 1 << 15
_SMALL = 48
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_ONE = np.uint64(1)


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, in lists of bounded size."""
    if len(text) <= _CHUNK:
        yield text.split()
        return
    at = 0
    while at < len(text):
        stop = _SPACE.search(text, min(at + _CHUNK, len(text)))
        end = stop.start() if stop else len(text)
        yield text[at:end].split()
        at = end


def _bit_counts(values: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(values), _BLOCK):
        rows = values[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles of one UTF-8 text in order, repeats included, in
    runs of bounded size; one of all words where there are fewer."""
    tail, some = [], False
    digest = xxhash.xxh64_intdigest
    for words in _word_runs((text or b"").lower()):
        words = tail + words
        if len(words) >= width:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            yield np.array([digest(s, 42) for s in grams], np.uint64)
            some, tail = True, words[len(words) - width + 1 :]
        else:
            tail = words
    if not some and tail:
        yield np.array([digest(b" ".join(tail), 42)], np.uint64)


def fingerprint_from(runs: Iterable[np.ndarray]) -> int:
    """The unsigned 64-bit fingerprint of runs of shingle hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in runs:
        counts += _bit_counts(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprint_of(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    return fingerprint_from(shingle_hashes(text, width))


def _fingerprints(texts: pa.Array) -> pa.Array:
    raw = texts.cast(pa.binary())
    values = [fingerprint_of(x.as_py()) for x in raw]
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed LONG holding the 64 bits."""
    return F.arrow_udf(_fingerprints, LongType())(text)


def fingerprint_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _variants(classes: DataFrame) -> DataFrame:
    """64 rows (key, fp) a fingerprint: segment, wildcard bit, other bits."""
    fp = F.col("fp")

    def one(k: Column) -> Column:
        segment = F.floor(k / 32).cast("int")
        bit = F.pmod(k, F.lit(32)).cast("int")
        part = F.when(segment == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
        kept = part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
        return kept + k.cast("long") * F.lit(1 << 32)

    return classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), one)).alias("key"), fp)


class _Forest:
    """Union-find over the fingerprints that one task has linked."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.parent
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and y != x:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _shared(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Neighbours among equal values, as two index arrays."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    yield order[:-1][same], order[1:][same]


def _large_run(key: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a large variant group, with two wildcards instead of pairs.

    Two members that agree outside two bits are within the limit, and any two
    members within it agree outside some two bits.  One sort for each choice
    of bits, linear in the group but for the sorting.
    """
    segment, bit = divmod(key >> 32, 32)
    other = [_ONE << np.uint64(b + 32 * (1 - segment)) for b in range(32)]
    wild = _ONE << np.uint64(bit + 32 * segment)
    for j in range(32):
        yield from _shared(fps & ~(wild | other[j]))
    if bit == 0:
        for j in range(32):
            for k in range(j):
                yield from _shared(fps & ~(other[j] | other[k]))


def _run_links(key: int, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(fps) > _SMALL:
        yield from _large_run(key, fps)
        return
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
    yield i[near], j[near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of the variant groups of one sorted partition."""
    forest = _Forest()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[list[int], list[int]]:
        a, b = [], []
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[cut, len(keys)])
        two = cut[size == 2]
        x, y = fps[two], fps[two + 1]
        near = np.bitwise_count(x ^ y) <= MAX_BITS
        pairs = [(x[near], y[near])]
        for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            run = fps[at : at + n]
            pairs += [(run[i], run[j]) for i, j in _run_links(int(keys[at]), run) if len(i)] if n <= _SMALL else []
            if n > _SMALL:
                for i, j in _run_links(int(keys[at]), run):
                    for p, q in zip(run[i].tolist(), run[j].tolist(), strict=True):
                        if forest.join(p, q):
                            a.append(p)
                            b.append(q)
        for x, y in pairs:
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                if forest.join(p, q):
                    a.append(p)
                    b.append(q)
        return a, b

    def out(a: list[int], b: list[int]) -> pa.RecordBatch:
        columns = [pa.array(np.array(v, np.uint64).view(np.int64), pa.int64()) for v in (a, b)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    for batch in gathered(batches):
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last or keys[0] != held[0][0][0]):
            # the group that was open ends in this batch: it is put together once
            stop = int(np.searchsorted(keys, held[0][0][0], "right"))
            parts = [*held, (keys[:stop], fps[:stop])]
            a, b = links_of(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            if a:
                yield out(a, b)
            held, keys, fps, last = [], keys[stop:], fps[stop:], last - stop
        if last > 0:
            a, b = links_of(keys[:last], fps[:last])
            if a:
                yield out(a, b)
            keys, fps = keys[last:], fps[last:]
        if len(keys):
            held.append((keys, fps))
    if held:
        a, b = links_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
        if a:
            yield out(a, b)


def near_links(classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints in column fp."""
    small_batches(classes.sparkSession)
    variants = _variants(classes).repartition("key").sortWithinPartitions("key")
    return variants.mapInArrow(leaving_nothing(_links), "a long, b long").distinct()


def components_of(prints: DataFrame, links: Callable[[DataFrame], DataFrame] = near_links) -> DataFrame:
    """(fp, root, component_id) of every fingerprint that is not alone.

    ``prints`` has doc_id and fp; ``links`` gives the links (a, b) of the
    distinct fingerprints in column fp.  A fingerprint of one row without links has
    no row here; its component is its own document.
    """
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = keep(classes, "classes")
    roots = connected_components(links(classes))
    joined = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    joined = joined.where((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))
    joined = keep(joined, "members")
    least = few(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    return joined.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of ``docs``."""
    small_batches(docs.sparkSession)
    prints = keep(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    found = components_of(prints).select("fp", F.col("component_id").alias("least"), F.lit(True).alias("grouped"))
    return prints.join(found, "fp", "left").select(
        "doc_id",
        fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.when(F.col("grouped"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row for each component of ``found`` (fp, root).

    ``prints`` has doc_id, mark (the XXH64 of the text) and fp of every row.
    """
    mark = fresh(docs, "text_mark")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    # the best row of a fingerprint, then of a component: copies meet no other row
    firsts = prints.groupBy("fp").agg(F.min(one).alias("first")).join(few(found.select("fp", "root"), "found"), "fp")
    firsts = keep(firsts, "firsts")
    best = few(firsts.groupBy("root").agg(F.min("first").alias("best")), "best")
    chosen = few(firsts.join(best, "root").select("fp", "best"), "chosen")
    lost = prints.join(chosen, "fp").where(one != F.col("best")).select("doc_id", "mark").distinct()
    repeated = prints.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    kept = docs.withColumn(mark, F.xxhash64("text"))
    lost = keep(lost.select(F.col("doc_id").alias("lost_id"), F.col("mark").alias("lost_mark")), "lost")
    kept = kept.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col(mark) == F.col("lost_mark")), "left_anti")
    repeated = keep(repeated, "repeated")
    if repeated.take(1):
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one with its smallest id.

    Among rows of that id the smallest text stays (null first), and of repeated
    rows one.  A component whose ids are all null keeps one row by that order.
    """
    mark = fresh(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    small_batches(docs.sparkSession)
    prints = keep(marked.select("doc_id", F.col(mark).alias("mark"), fingerprint(F.col("text")).alias("fp")), "prints")
    return one_of_each(docs, prints, components_of(prints.select("doc_id", "fp")))


__all__ = ["components_of", "drop_near_duplicates", "fingerprint", "fingerprint_from", "fingerprint_of", "shingle_hashes", "simhash_components"]
