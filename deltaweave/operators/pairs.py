"""Operators on pairs of streams: rows (stream_id, old, new) with two contents.

A pair stays in its row and its task; kernels run on Arrow batches and nothing
is shuffled.  A null content is an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import formats, kernels
from .covers import violations
from .tables import parts, written

COVER_COLUMNS = "old_pos long, new_pos long, length long"
COVER_LIST = "array<struct<new_pos:bigint,old_pos:bigint,length:bigint>>"
#: Rows that a task hands on at a time.
BATCH_ROWS = 1 << 16
Kernel = Callable[[np.ndarray, np.ndarray], list[tuple]]


def _each(kernel: Kernel, kinds: list[pa.DataType], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            ids, rows = [], []
            for i in range(batch.num_rows):
                found = kernel(kernels.as_array(batch.column(1)[i].as_py()), kernels.as_array(batch.column(2)[i].as_py()))
                ids += [i] * len(found)
                rows += found
                if len(rows) >= BATCH_ROWS or i + 1 == batch.num_rows:
                    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["stream_id", *names])
                    ids, rows = [], []

    return run


def _apply(pairs: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    arrow = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    parts = [p.split() for p in schema.split(", ")]
    kind = pairs.schema["stream_id"].dataType.simpleString()
    run = _each(kernel, [arrow[k] for _, k in parts], [n for n, _ in parts])
    return pairs.select("stream_id", "old", "new").mapInArrow(run, f"stream_id {kind}, {schema}")


def _apply_arrays(pairs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], tuple], names: list[str]) -> DataFrame:
    """Like :func:`_apply` for kernels whose columns are arrays of LONG; a value
    below zero is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            found = [kernel(kernels.as_array(o.as_py()), kernels.as_array(n.as_py())) for o, n in zip(part.column(1), part.column(2), strict=True)]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            columns = [np.concatenate([f[k] for f in found]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64(), mask=c < 0) for c in columns)], ["stream_id", *names])

    kind = pairs.schema["stream_id"].dataType.simpleString()
    return pairs.select("stream_id", "old", "new").mapInArrow(run, f"stream_id {kind}, " + ", ".join(f"{n} long" for n in names))


def sequential_matches(pairs: DataFrame, size: int) -> DataFrame:
    """(stream_id, block_index, old_index) of whole blocks of new that equal an old
    one together with the next block, the least old block where there are several."""
    return _apply_arrays(pairs, lambda old, new: kernels.sequential_blocks(old, new, size), ["block_index", "old_index"])


def nearest_matches(pairs: DataFrame, size: int) -> DataFrame:
    """(stream_id, new_pos, old_pos): for each whole block of new the equal block of
    old that lies nearest to the usual diagonal, the lesser place on a tie."""
    return _apply_arrays(pairs, lambda old, new: kernels.nearest_blocks(old, new, size), ["new_pos", "old_pos"])


def sync_positions(pairs: DataFrame, size: int) -> DataFrame:
    """(stream_id, block_index, new_pos, length, old_pos) of each whole block of
    new; ``old_pos`` is its first place in old, at any offset, or null."""

    def kernel(old: np.ndarray, new: np.ndarray) -> tuple:
        found = kernels.sync_positions(old, new, size)
        index = np.arange(len(found), dtype=np.int64)
        return index, index * size, np.full(len(found), size, np.int64), found

    return _apply_arrays(pairs, kernel, ["block_index", "new_pos", "length", "old_pos"])


def sign_positions(pairs: DataFrame, size: int) -> DataFrame:
    """(stream_id, old_index, old_pos, new_pos) of whole blocks of old: their first
    place in new, at any offset, where there is one."""

    def kernel(old: np.ndarray, new: np.ndarray) -> list[tuple]:
        found = kernels.sync_positions(new, old, size).tolist()
        return [(i, i * size, at) for i, at in enumerate(found) if at >= 0]

    return _apply(pairs, kernel, "old_index long, old_pos long, new_pos long")


def candidate_covers(pairs: DataFrame, size: int) -> DataFrame:
    """Maximal runs, by diagonal, of offsets of new that meet an aligned old block.

    Equal old blocks count by the first.  Candidates may overlap in new.
    """

    def kernel(old: np.ndarray, new: np.ndarray) -> list[tuple]:
        starts = np.arange(len(old) // size, dtype=np.int64) * size
        hashes = kernels.window_hashes(new, size)
        if not len(starts) or not len(hashes):
            return []
        table, first = np.unique(kernels.window_hashes(old, size)[starts], return_index=True)
        place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        at = np.flatnonzero(table[place] == hashes)
        if not len(at):
            return []
        i = starts[first[place[at]]]
        fits = np.array([kernels.same_bytes(old, a, new, b, size) for a, b in zip(i, at, strict=True)], bool)
        return sorted(zip(i[fits].tolist(), at[fits].tolist(), strict=True))

    hits = _apply(pairs, kernel, "old_pos long, new_pos long")
    return hits.withColumn("length", F.lit(size).cast("long"))


def diagonal_islands(hits: DataFrame) -> DataFrame:
    """Hits of one size that overlap or touch on a diagonal become one cover."""
    from pyspark.sql import Window

    hits = hits.withColumn("diagonal", F.col("new_pos") - F.col("old_pos"))
    order = Window.partitionBy("stream_id", "diagonal").orderBy("new_pos")
    head = F.coalesce(F.col("new_pos") - F.lag("new_pos").over(order) > F.col("length"), F.lit(True))
    islands = hits.withColumn("head", head.cast("int")).withColumn("island", F.sum("head").over(order))
    grouped = islands.groupBy("stream_id", "diagonal", "island")
    return grouped.agg(F.min("old_pos").alias("old_pos"), F.min("new_pos").alias("new_pos"), (F.max(F.col("new_pos") + F.col("length")) - F.min("new_pos")).alias("length")).drop("diagonal", "island")


FINDERS: dict[str, Callable[..., list]] = {
    "block": lambda old, new, size=64: kernels.block_covers(old, new, size),
    "longest": lambda old, new, size=0: kernels.longest_covers(old, new),
    "selected": lambda old, new, size=0: kernels.select_covers(old, new, kernels.extend_covers(old, new, kernels.link_covers(kernels.longest_covers(old, new), old=old, new=new))),
}


def block_then_longest(old: np.ndarray, new: np.ndarray, size: int = 64) -> list:
    """Block covers first, longest matches in what they leave, put together."""
    covers = kernels.block_covers(old, new, size)
    out, end, index = list(covers), 0, None
    for _, j, n in [*covers, (0, len(new), 0)]:
        if j - end >= 16:
            index = index or kernels.Suffixes(old)
            out += [(a, b + end, m) for a, b, m in kernels.longest_covers(old, new[end:j], index=index)]
        end = j + n
    return kernels.collate_covers(out)


FINDERS["mixed"] = block_then_longest


def find_covers(pairs: DataFrame, finder: str = "block", size: int = 64) -> DataFrame:
    """Covers (stream_id, old_pos, new_pos, length) of each pair, free of overlap."""
    kernel = FINDERS[finder]
    return _apply(pairs, lambda old, new: kernel(old, new, size), COVER_COLUMNS)


def find_covers_in_chunks(pairs: DataFrame, finder: str = "block", size: int = 64, chunk: int = 8 << 20, overlap: int = 2 << 10) -> DataFrame:
    """Covers of long streams: chunks of new are matched by separate tasks.

    A chunk reaches ``overlap`` bytes into the next one; the covers of a stream
    are then put in order and freed of overlap.  A cover that meets the end of its
    chunk grows on over some bytes behind it: the next chunk may have taken another
    old place there, whose end leaves less than a block to find.  The few streams in
    which one meets the end of those bytes as well are grown once more, whole.
    """
    kernel, ahead = FINDERS[finder], max(2 * size, 64)

    def within(old: np.ndarray, new: np.ndarray) -> list[tuple]:
        part = new[: chunk + overlap]
        found = kernel(old, part, size)
        if found and found[-1][1] + found[-1][2] == len(part) < len(new):
            i, j, n = found[-1]
            found[-1] = (i, j, n + kernels.common_prefix(old[i + n :], new[j + n :]))
        return found

    count = F.greatest(F.ceil(F.octet_length("new") / chunk).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.struct((c.cast("long") * chunk).alias("begin"), F.substring("new", c * chunk + 1, chunk + overlap + ahead).alias("part")))
    rows = pairs.select("stream_id", "old", F.explode(cut).alias("c")).select(F.struct("stream_id", "c.begin").alias("key"), "old", F.col("c.part").alias("new"))
    rows = rows.repartition("key").withColumnRenamed("key", "stream_id")
    found = _apply(rows, within, COVER_COLUMNS)
    found = found.select("stream_id.stream_id", "old_pos", (F.col("new_pos") + F.col("stream_id.begin")).alias("new_pos"), "length")

    def collate(table: pa.Table) -> pa.Table:
        covers = zip(*(table.column(c).to_pylist() for c in ("old_pos", "new_pos", "length")), strict=True)
        made = kernels.collate_covers(list(covers))
        columns = list(zip(*made, strict=True)) if made else [[], [], []]
        begins = [*columns[1][1:], None]
        open_end = any((j + n - overlap - ahead) % chunk == 0 and j + n != after for (_, j, n), after in zip(made, begins, strict=True))
        ids = table.column("stream_id").combine_chunks().take(pa.array([0] * len(made), pa.int64()))
        return pa.table([ids, *(pa.array(c, pa.int64()) for c in columns), pa.array([open_end] * len(made), pa.bool_())], names=["stream_id", "old_pos", "new_pos", "length", "open_end"])

    kind = pairs.schema["stream_id"].dataType.simpleString()
    collated = written(found.groupBy("stream_id").applyInArrow(collate, f"stream_id {kind}, {COVER_COLUMNS}, open_end boolean"), "chunks")
    lists = collated.where("open_end").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("new_pos", "old_pos", "length"))).alias("covers"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch)):
            for i in range(part.num_rows):
                covers = [(c["old_pos"], c["new_pos"], c["length"]) for c in part.column(3)[i].as_py()]
                made = kernels.grow_ends(kernels.as_array(part.column(1)[i].as_py()), kernels.as_array(part.column(2)[i].as_py()), covers)
                ids = part.column(0).take(pa.array([i] * len(made), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*made, strict=True))], ["stream_id", "old_pos", "new_pos", "length"])

    grown = pairs.select("stream_id", "old", "new").join(lists, "stream_id").mapInArrow(grow, f"stream_id {kind}, {COVER_COLUMNS}")
    return collated.where("NOT open_end").drop("open_end").unionByName(grown)


def covers_of(diffs: DataFrame) -> DataFrame:
    """The covers that containers (stream_id, diff) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = formats.covers_in(batch.column(1)[i].as_py())
                columns = zip(*found, strict=True) if found else [[], [], []]
                ids = batch.column(0).take(pa.array([i] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["stream_id", "old_pos", "new_pos", "length"])

    kind = diffs.schema["stream_id"].dataType.simpleString()
    return diffs.select("stream_id", "diff").mapInArrow(run, f"stream_id {kind}, {COVER_COLUMNS}")


def find_steps(pairs: DataFrame, finder: str = "block", step_bytes: int = formats.STEP_BYTES) -> DataFrame:
    """(stream_id, step_no, first_new, covers, cover_bytes, run_code, literal) of each step."""
    kernel = FINDERS[finder]

    def rows(old: np.ndarray, new: np.ndarray) -> list[tuple]:
        steps = formats.step_rows(old, new, kernel(old, new), step_bytes)
        return [(k, step[0][1] if step else 0, b"".join(np.array(c, "<i8").tobytes() for c in step), sum(n for *_, n in step), run, b"".join(parts)) for k, (step, run, parts) in enumerate(steps)]

    return _apply(pairs, rows, "step_no long, first_new long, covers binary, cover_bytes long, run_code binary, literal binary")


def pack_steps(covers: DataFrame, step_bytes: int) -> DataFrame:
    """(stream_id, step_no, old_pos, new_pos, length): covers in steps whose cover
    bytes stay in ``step_bytes``; a cover over it is cut.

    The steps of a stream follow each other, so its covers (numbers, no bytes)
    are gathered in one row.
    """
    listed = covers.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("new_pos", "old_pos", "length"))).alias("covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(batch.column(1).to_pylist()):
                steps = kernels.steps_of([(c["old_pos"], c["new_pos"], c["length"]) for c in found], step_bytes)
                rows = [(k, *c) for k, step in enumerate(steps) for c in step]
                columns = zip(*rows, strict=True) if rows else [[], [], [], []]
                ids = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["stream_id", "step_no", "old_pos", "new_pos", "length"])

    kind = covers.schema["stream_id"].dataType.simpleString()
    return listed.mapInArrow(run, f"stream_id {kind}, step_no long, {COVER_COLUMNS}")


def step_covers(steps: DataFrame) -> DataFrame:
    """(stream_id, step_no, old_pos, new_pos, length): what each step row of
    :func:`find_steps` is about to copy, batch or streaming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(v.as_py()) // 24 for v in batch.column(2)]
            rows = np.frombuffer(b"".join(v.as_py() for v in batch.column(2)), "<i8").reshape(-1, 3)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(rows[:, k].copy()) for k in range(3))], ["stream_id", "step_no", "old_pos", "new_pos", "length"])

    kind = steps.schema["stream_id"].dataType.simpleString()
    return steps.select("stream_id", "step_no", "covers").mapInArrow(run, f"stream_id {kind}, step_no long, {COVER_COLUMNS}")


def diff(pairs: DataFrame, kind: str = "steps", packing: str = "zlib", finder: str = "block") -> DataFrame:
    """(stream_id, diff, new_size) of each pair, as one container."""
    kernel = FINDERS[finder]

    def rows(old: np.ndarray, new: np.ndarray) -> list[tuple]:
        return [(formats.encode(kind, old, new, kernel(old, new), packing), len(new))]

    return _apply(pairs, rows, "diff binary, new_size long")


def diffs(pairs: DataFrame, kinds: list[str], packing: str = "zlib", finder: str = "block") -> DataFrame:
    """(stream_id, kind, diff, new_size) of each pair in several containers, which
    share one list of covers."""
    kernel = FINDERS[finder]

    def rows(old: np.ndarray, new: np.ndarray) -> list[tuple]:
        covers = kernel(old, new)
        return [(kind, formats.encode(kind, old, new, covers, packing), len(new)) for kind in kinds]

    return _apply(pairs, rows, "kind string, diff binary, new_size long")


def with_diff(pairs: DataFrame, kind: str = "steps", packing: str = "zlib", finder: str = "block") -> DataFrame:
    """Pairs with their ``diff`` as one container and ``new_size`` beside them, for a
    use that has both streams at hand: nothing is shuffled."""
    kernel = FINDERS[finder]

    def run(olds: pa.Array, news: pa.Array) -> pa.Array:
        made = []
        for part in parts(pa.RecordBatch.from_arrays([olds, news], ["old", "new"])):
            for o, n in zip(*part.columns, strict=True):
                old, new = kernels.as_array(o.as_py()), kernels.as_array(n.as_py())
                made.append(formats.encode(kind, old, new, kernel(old, new), packing))
        return pa.array(made, pa.binary())

    size = F.coalesce(F.octet_length("new").cast("long"), F.lit(0).cast("long"))
    return pairs.withColumn("diff", F.arrow_udf(run, BinaryType())("old", "new")).withColumn("new_size", size)


def patched(old: Column, diff: Column, new_size: Column) -> Column:
    """What a container makes of old.  One that is damaged or belongs to another
    old stream raises."""

    def run(olds: pa.Array, diffs: pa.Array, sizes: pa.Array) -> pa.Array:
        made = []
        for part in parts(pa.RecordBatch.from_arrays([olds, diffs, sizes], ["old", "diff", "new_size"])):
            made += [formats.decode(kernels.as_array(o.as_py()), d.as_py(), n.as_py()) for o, d, n in zip(*part.columns, strict=True)]
        return pa.array(made, pa.binary())

    return F.arrow_udf(run, BinaryType())(old, diff, new_size)


def patch(diffs: DataFrame) -> DataFrame:
    """(stream_id, made) from rows (stream_id, old, diff, new_size)."""
    return diffs.select("stream_id", patched(F.col("old"), F.col("diff"), F.col("new_size")).alias("made"))


def resave(diffs: DataFrame, packing: str) -> DataFrame:
    """Section containers with the same covers under another compressor."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([formats.resave_sections(v.as_py(), packing) if v.is_valid else None for v in values], pa.binary())

    return diffs.withColumn("diff", F.arrow_udf(run, BinaryType())("diff"))


def rebuilt(old: Column, new: Column, covers: Column) -> Column:
    """A new stream from old bytes under its list of covers and literals from new."""

    def piece(c, i):  # noqa: ANN001, ANN202
        last = F.get(covers, i - 1)
        end = F.when(i == 0, F.lit(0)).otherwise(last["new_pos"] + last["length"])
        literal = F.substring(new, (end + 1).cast("int"), (c["new_pos"] - end).cast("int"))
        return F.hex(F.concat(literal, F.substring(old, (c["old_pos"] + 1).cast("int"), c["length"].cast("int"))))

    last = F.try_element_at(covers, F.lit(-1))
    end = F.coalesce(last["new_pos"] + last["length"], F.lit(0))
    tail = F.substring(new, (end + 1).cast("int"), F.octet_length(new))
    made = F.array_join(F.transform(covers, piece), "")
    return F.unhex(F.concat(made, F.hex(tail)))


def growable(old: Column, new: Column, covers: Column) -> Column:
    """How many covers of a list could be longer at their end: the next bytes of
    both streams are equal, and no other cover begins there."""

    def grows(c, i):  # noqa: ANN001, ANN202
        a, b = c["old_pos"] + c["length"], c["new_pos"] + c["length"]
        stop = F.coalesce(F.get(covers, i + 1)["new_pos"], F.octet_length(new))
        free = (a < F.octet_length(old)) & (b < stop)
        return free & (F.substring(old, (a + 1).cast("int"), F.lit(1)) == F.substring(new, (b + 1).cast("int"), F.lit(1)))

    return F.size(F.filter(F.transform(covers, grows), lambda g: g)).cast("long")


def rebuild(pairs: DataFrame, covers: DataFrame) -> DataFrame:
    """(stream_id, made): new streams from old bytes under covers and new literals.

    The covers of a stream are gathered into one list and joined to its pair,
    so only covers are grouped, not bytes.
    """
    lists = covers.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("new_pos", "old_pos", "length"))).alias("covers"))
    listed = pairs.join(lists, "stream_id", "left").withColumn("covers", F.coalesce("covers", F.array().cast(COVER_LIST)))
    return listed.select("stream_id", rebuilt(F.col("old"), F.col("new"), F.col("covers")).alias("made"))


def checked_rebuilds(pairs: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(finder, stream_id, made, growable, wrong) of the covers of several finders:
    what they rebuild, how many could be longer at their end, and how many break
    a rule.

    Every finder runs once: its covers (numbers) are written; all lists of a
    stream meet its pair in one join.
    """
    tagged = [table.select(F.lit(name).alias("finder"), "stream_id", "old_pos", "new_pos", "length") for name, table in found.items()]
    every = written(functools.reduce(DataFrame.unionByName, tagged), "covers")
    finders = F.explode(F.array(*map(F.lit, found))).alias("finder")
    lists = every.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("finder", "new_pos", "old_pos", "length"))).alias("list"))
    mine = F.transform(F.filter("list", lambda c: c["finder"] == F.col("finder")), lambda c: F.struct(c["new_pos"].alias("new_pos"), c["old_pos"].alias("old_pos"), c["length"].alias("length")))
    rows = pairs.join(lists, "stream_id", "left").select("stream_id", "old", "new", "list", finders)
    rows = rows.select("finder", "stream_id", "old", "new", F.coalesce(mine, F.array().cast(COVER_LIST)).alias("covers"))
    made = rows.select("finder", "stream_id", rebuilt(F.col("old"), F.col("new"), F.col("covers")).alias("made"), growable(F.col("old"), F.col("new"), F.col("covers")).alias("growable"))
    key = F.struct("finder", "stream_id").alias("stream_id")
    sizes = pairs.select("stream_id", F.octet_length("old").cast("long").alias("old_size"), F.octet_length("new").cast("long").alias("new_size")).select("*", finders)
    broken = violations(every.select(key, "old_pos", "new_pos", "length"), sizes.select(key, "old_size", "new_size"))
    counted = broken.groupBy("stream_id.finder", "stream_id.stream_id").agg(F.count(F.lit(1)).alias("wrong"))
    return made.join(counted, ["finder", "stream_id"], "left").withColumn("wrong", F.coalesce("wrong", F.lit(0).cast("long")))
