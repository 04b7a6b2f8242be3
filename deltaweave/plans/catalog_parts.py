"""Queries of single operators beside those of :mod:`catalog`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums
from ..operators import blocks, bytes as byte_ops, covers, files, pairs
from ..sources import manifests
from . import directory, sync
from .catalog import _APPLIED, _BLOCKS, _BOTH_BYTES, _BYTE, _COVERS, _FILES, _LAYOUT, _NEEDED, _NEW, _PAIRS, _RUNS, _SIGNED, _SYNC, B, _files, _layout, _sums, _sums_sql, old_streams, query, sync_covers, sync_rows, text_pairs


# bytes and numbers


@query(_sums_sql(f"((({_BYTE} + 1) * 2654435761) % 4294967296) >> 16", 1 << 16, 1))
def block_fadler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, checksums.fadler32)


_WIDE = f"list_transform(range(0, len(b) // 2), lambda j: (({_BYTE} + 1)::HUGEINT * 11400714819323198485) % 18446744073709551616)"
_SIGN = "(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END)::BIGINT"


@query(
    f"""WITH {_BLOCKS}, listed AS (SELECT stream_id, block_index, {_WIDE} AS v FROM blocks), placed AS (
    SELECT stream_id, block_index, len(v) AS n, unnest(v) AS v, unnest(range(len(v), 0, -1)) AS place FROM listed), summed AS (
    SELECT stream_id, block_index, (1 + sum(v)) % 18446744073709551616 AS a, (any_value(n) + sum(v * place)) % 18446744073709551616 AS s FROM placed GROUP BY 1, 2)
    SELECT stream_id, block_index, {_SIGN.format("a")} AS a, {_SIGN.format("s")} AS s FROM summed"""
)
def block_fadler128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, checksums.fadler128)


_GROUPS = "(CASE " + " ".join(f"WHEN n < {1 << (7 * k)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)"


@query(
    f"""WITH numbers AS (SELECT doc_id AS stream_id, strlen(text) * 1000003 + doc_id AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    groups AS (SELECT stream_id, n, {_GROUPS} AS size FROM numbers)
    SELECT stream_id, n, array_to_string(list_transform(range(size, 0, -1),
        lambda k: printf('%02X', ((n >> (7 * (k - 1))) & 127) + CASE WHEN k > 1 THEN 128 ELSE 0 END)), '') AS code, n AS decoded FROM groups"""
)
def varint_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("content").cast("long") * 1000003 + F.col("stream_id")
    coded = old_streams(spark, sf_dir).where("stream_id IS NOT NULL").select("stream_id", n.alias("n"), byte_ops.packed_varint(n).alias("code"))
    return coded.select("stream_id", "n", F.hex("code").alias("code"), byte_ops.unpacked_varint(F.col("code")).alias("decoded"))


_NEW_BYTES = f"""{_PAIRS}, cut AS (SELECT stream_id, c, substr(n, 2048 * c + 1, 2048) AS b, least(old_size, new_size) AS size
    FROM (SELECT stream_id, n, old_size, new_size, unnest(range(0, (least(old_size, new_size) + 1023) // 1024)) AS c FROM pairs)),
    new_bytes AS (SELECT stream_id, size, c * 1024 + j AS pos, ('0x' || substr(b, 2 * j + 1, 2))::BIGINT AS value
        FROM (SELECT stream_id, c, b, size, unnest(range(0, len(b) // 2)) AS j FROM cut))"""


@query(f"WITH {_NEW_BYTES} SELECT stream_id, count(*) AS bytes, sum(value * (pos % 251 + 1))::BIGINT AS weighed FROM new_bytes WHERE pos < size GROUP BY stream_id")
def added_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two streams put on the old one again gives the new one."""
    made = byte_ops.add(byte_ops.subtract(F.col("new"), F.col("old")), F.col("old"))
    found = text_pairs(spark, sf_dir).select("stream_id", byte_ops.byte_sums(made).alias("s"))
    return found.where("s.bytes > 0").select("stream_id", "s.bytes", "s.weighed")


@query(f"WITH {_RUNS} SELECT stream_id, count(*) AS bytes, sum(value * (pos % 251 + 1))::BIGINT AS weighed FROM bytes GROUP BY stream_id")
def expanded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal bytes expanded give the bytes again."""
    found = byte_ops.run_lists(old_streams(spark, sf_dir)).select("stream_id", byte_ops.byte_sums(byte_ops.expand_runs(F.col("values"), F.col("lengths"))).alias("s"))
    return found.where("s.bytes > 0").select("stream_id", "s.bytes", "s.weighed")


@query(
    f"""WITH {_BOTH_BYTES}, first AS (SELECT stream_id, min(pos) AS pos FROM difference WHERE d <> 0 GROUP BY stream_id)
    SELECT p.stream_id, coalesce(f.pos, least(old_size, new_size)) AS length FROM pairs AS p LEFT JOIN first AS f ON p.stream_id = f.stream_id"""
)
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_pairs(spark, sf_dir).select("stream_id", byte_ops.common_prefix_length(F.col("old"), F.col("new")).alias("length"))


@query(f"""WITH {_SIGNED}, hashed AS (SELECT DISTINCT strong, ('0x' || substr(strong, 1, 8))::BIGINT AS h FROM signed)
    SELECT strong, xor(h >> 16, h) & 65535 AS folded, xor(h >> 20, h) & 1048575 AS folded_20 FROM hashed""")
def folded_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = blocks.signatures(old_streams(spark, sf_dir), B).select("strong").distinct()
    h = F.conv(F.substring("strong", 1, 8), 16, 10).cast("long")
    return strong.select("strong", checksums.fold_bits(h, 16).alias("folded"), checksums.fold_bits(h, 20).alias("folded_20"))


@query(f"""WITH {_SIGNED} SELECT DISTINCT strong, substr(strong, 1, 8) AS bits_32,
    printf('%02x', ('0x' || substr(strong, 1, 2))::BIGINT & 15) || substr(strong, 3, 4) AS bits_20 FROM signed""")
def truncated_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = blocks.signatures(old_streams(spark, sf_dir), B).select("strong").distinct()
    return strong.select("strong", checksums.truncate_digest(F.col("strong"), 32).alias("bits_32"), checksums.truncate_digest(F.col("strong"), 20).alias("bits_20"))


def _log2(value: str) -> str:
    return f"(CASE WHEN {value} <= 2 THEN 1 ELSE length(ltrim(bin({value} - 1), '0')) END)"


@query(
    f"""WITH sized AS (SELECT doc_id AS stream_id, strlen(text) AS size, (strlen(text) + {B - 1}) // {B} AS n FROM documents WHERE text IS NOT NULL),
    logs AS (SELECT stream_id, {_log2("size")}::BIGINT AS size_bits, {_log2("n")}::BIGINT AS block_bits FROM sized),
    rolled AS (SELECT *, least(greatest(size_bits + 1, 14), 32) AS rolling_bits FROM logs)
    SELECT stream_id, size_bits, block_bits, rolling_bits, greatest(size_bits + block_bits + 24 - rolling_bits, 14) AS strong_bits FROM rolled"""
)
def hash_bit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("content").cast("long")
    sized = old_streams(spark, sf_dir).select("stream_id", size.alias("size"), blocks.block_count(size, B).alias("n"))
    rolling_bits, strong_bits = checksums.hash_bits_of(F.col("size"), F.col("n"))
    return sized.select("stream_id", checksums.ceil_log2_of(F.col("size")).alias("size_bits"), checksums.ceil_log2_of(F.col("n")).alias("block_bits"), rolling_bits.alias("rolling_bits"), strong_bits.alias("strong_bits"))


@query(
    f"""WITH sized AS (SELECT doc_id AS stream_id, strlen(text) AS size FROM documents WHERE text IS NOT NULL)
    SELECT stream_id, (size + {B - 1}) // {B} AS blocks, CASE WHEN size > 0 THEN (size - 1) % {B} + 1 ELSE 0 END AS tail,
    least(((size + {B - 1}) // {B} - 1) * {B}, size - {B}) AS last_pos,
    greatest(4, least(1024, ((greatest(size, 1) + 63) // 64 + 63) // 64 * 64)) AS clamped FROM sized"""
)
def block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, the size of the last one, its place where it is moved back to end
    the stream, and a block size that suits the stream."""
    from ..options import block_size_of

    size = F.col("size")
    sized = old_streams(spark, sf_dir).select("stream_id", F.octet_length("content").cast("long").alias("size"))
    count = blocks.block_count(size, B)
    return sized.select("stream_id", count.alias("blocks"), blocks.tail_size(size, B).alias("tail"), blocks.shifted_position(count - 1, size, B).alias("last_pos"), block_size_of(size, 1024).alias("clamped"))


# covers and steps


@query(
    f"""WITH {_COVERS}, chained AS (SELECT *, CASE WHEN new_pos - lag(new_pos + length) OVER o <= 511 AND lag(old_pos - new_pos) OVER o = old_pos - new_pos THEN 0 ELSE 1 END AS link
        FROM covers WINDOW o AS (PARTITION BY stream_id ORDER BY new_pos)),
    islands AS (SELECT *, sum(link) OVER (PARTITION BY stream_id ORDER BY new_pos) AS island FROM chained)
    SELECT stream_id, min(old_pos) AS old_pos, min(new_pos) AS new_pos, max(new_pos + length) - min(new_pos) AS length FROM islands GROUP BY stream_id, island"""
)
def linked_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.link_near(sync_covers(spark, sf_dir))


_PARTS = """old_parts AS (SELECT stream_id, 150 * k AS pos, 100 AS length, 100 * k AS begin FROM (SELECT stream_id, unnest(range(0, (old_size + 50) // 150)) AS k FROM pairs)),
    new_parts AS (SELECT stream_id, 90 * k AS pos, 80 AS length, 80 * k AS begin FROM (SELECT stream_id, unnest(range(0, (new_size + 10) // 90)) AS k FROM pairs))"""


@query(
    f"""WITH {_COVERS}, {_PARTS}, first_cut AS (SELECT c.stream_id, p.pos + greatest(c.old_pos, p.begin) - p.begin AS old_pos,
        c.new_pos + greatest(c.old_pos, p.begin) - c.old_pos AS new_pos, least(c.old_pos + c.length, p.begin + 100) - greatest(c.old_pos, p.begin) AS length
        FROM covers AS c JOIN old_parts AS p ON c.stream_id = p.stream_id AND p.begin < c.old_pos + c.length AND p.begin + 100 > c.old_pos)
    SELECT c.stream_id, c.old_pos + greatest(c.new_pos, p.begin) - c.new_pos AS old_pos, p.pos + greatest(c.new_pos, p.begin) - p.begin AS new_pos,
        least(c.new_pos + c.length, p.begin + 80) - greatest(c.new_pos, p.begin) AS length
        FROM first_cut AS c JOIN new_parts AS p ON c.stream_id = p.stream_id AND p.begin < c.new_pos + c.length AND p.begin + 80 > c.new_pos"""
)
def unpacked_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers of streams that were packed from parts, at their original places."""

    def parts(column: str, step: int, length: int) -> DataFrame:
        count = F.floor((F.octet_length(column) + (step - length)) / step).cast("int")
        each = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        rows = text_pairs(spark, sf_dir).select("stream_id", F.explode(each).alias("k"))
        return rows.select("stream_id", (F.col("k").cast("long") * step).alias("pos"), F.lit(length).cast("long").alias("length"))

    return covers.unpack_covers(sync_covers(spark, sf_dir), parts("old", 150, 100), parts("new", 90, 80), 1024)


@query(
    f"""WITH {_SYNC}, ranges AS (SELECT stream_id, min(new_pos) AS first_byte, max(new_pos + length - 1) AS last_byte, count(*) AS blocks FROM (
    SELECT *, block_index - row_number() OVER (PARTITION BY stream_id ORDER BY block_index) AS island FROM sync WHERE old_pos IS NULL) GROUP BY stream_id, island)
    SELECT *, (row_number() OVER (PARTITION BY stream_id ORDER BY first_byte) - 1) // 2 AS request FROM ranges"""
)
def download_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.request_batches(covers.needed_ranges(sync_rows(spark, sf_dir)), 2)


# a fold over the covers of each stream: (cover, place in it, bytes used, step)
_STEPS = f"""WITH RECURSIVE {_COVERS}, listed AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY new_pos) AS k FROM covers),
    fold AS (
        SELECT stream_id, 1 AS k, 0::BIGINT AS done, 0::BIGINT AS used, 0::BIGINT AS step_no, NULL::BIGINT AS old_pos, NULL::BIGINT AS new_pos, NULL::BIGINT AS length
        FROM (SELECT DISTINCT stream_id FROM listed)
        UNION ALL
        SELECT stream_id, CASE WHEN done + part = whole THEN k + 1 ELSE k END, CASE WHEN done + part = whole THEN 0 ELSE done + part END,
               CASE WHEN over THEN part ELSE used + part END, CASE WHEN over THEN step_no + 1 ELSE step_no END, old_begin + done, new_begin + done, part
        FROM (SELECT *, used + part > 1000 AND used > 0 AS over FROM (
            SELECT f.stream_id, f.k, f.done, f.used, f.step_no, c.old_pos AS old_begin, c.new_pos AS new_begin, c.length AS whole,
                   (SELECT max(size) FROM (SELECT unnest(list_reduce(list_prepend([c.length - f.done], list_transform(range(0, 60), lambda i: [0::BIGINT])),
                       lambda a, x: list_append(a, CASE WHEN a[-1] > 1000 THEN greatest(1, a[-1] * 3 // 4) ELSE a[-1] END))) AS size) WHERE size <= 1000) AS part
            FROM fold AS f JOIN listed AS c ON f.stream_id = c.stream_id AND f.k = c.k))
    ) SELECT stream_id, step_no, old_pos, new_pos, length FROM fold WHERE length IS NOT NULL"""


@query(_STEPS)
def cover_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers in steps of 1,000 bytes; a larger cover goes by three quarters."""
    return pairs.pack_steps(sync_covers(spark, sf_dir), 1000)


_REBUILDS = " UNION ALL ".join(f"SELECT '{f}' AS finder, doc_id AS stream_id, md5({_NEW}) AS made_md5, 0::BIGINT AS wrong FROM documents WHERE text IS NOT NULL" for f in ("block", "chunks", "containers", "longest", "mixed", "steps"))


@query(_REBUILDS)
def cover_rebuilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the covers of each finder and the bytes under none of them make of
    old, and how many covers break a rule or could be longer at their end."""
    both = text_pairs(spark, sf_dir)
    read_back = pairs.covers_of(pairs.diff(both, "steps", "zlib", "block"))
    by_step = pairs.step_covers(pairs.find_steps(both, "block", 4096)).drop("step_no")
    found = {
        "block": pairs.find_covers(both, "block"),
        "longest": pairs.find_covers(both, "longest"),
        "mixed": pairs.find_covers(both, "mixed"),
        "chunks": pairs.find_covers_in_chunks(both, "block", B, 4096, 512),
        "containers": read_back,
        "steps": by_step,
    }
    made = pairs.checked_rebuilds(both, found)
    return made.select("finder", "stream_id", F.md5("made").alias("made_md5"), (F.col("wrong") + F.col("growable")).alias("wrong"))


@query(
    f"""WITH {_SIGNED}, heads AS (SELECT strong FROM signed WHERE block_index = 0)
    SELECT stream_id, block_index, strong FROM signed WHERE block_index > 0 AND strong IN (SELECT strong FROM heads)"""
)
def prefiltered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later blocks that are the first block of some stream."""
    signed = blocks.signatures(old_streams(spark, sf_dir), B)
    return blocks.known_blocks(signed.where("block_index > 0"), signed.where("block_index = 0")).select("stream_id", "block_index", "strong")


@query(
    f"""WITH {_SIGNED}, keyed AS (SELECT stream_id, block_index, strong, coalesce(lead(strong) OVER o, '') AS a, coalesce(lead(strong, 2) OVER o, '') AS b
        FROM signed WINDOW o AS (PARTITION BY stream_id ORDER BY block_index))
    SELECT stream_id, block_index, row_number() OVER (PARTITION BY stream_id ORDER BY strong, a, b, block_index DESC) - 1 AS place FROM keyed"""
)
def digest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.digest_order(blocks.signatures(old_streams(spark, sf_dir), B))


# blocks of eight bytes, so that many are equal
_EIGHTS = f"""{_PAIRS}, a AS (SELECT stream_id, 8 * k AS pos, substr(n, 16 * k + 1, 16) AS b FROM (SELECT stream_id, n, unnest(range(0, new_size // 8)) AS k FROM pairs)),
    b AS (SELECT stream_id, 8 * k AS pos, substr(o, 16 * k + 1, 16) AS b FROM (SELECT stream_id, o, unnest(range(0, old_size // 8)) AS k FROM pairs)),
    once AS (SELECT x.stream_id, y.pos - x.pos AS diagonal FROM (SELECT stream_id, b, min(pos) AS pos FROM a GROUP BY 1, 2 HAVING count(*) = 1) AS x
        JOIN (SELECT stream_id, b, min(pos) AS pos FROM b GROUP BY 1, 2 HAVING count(*) = 1) AS y ON x.stream_id = y.stream_id AND x.b = y.b),
    usual AS (SELECT stream_id, diagonal FROM (SELECT stream_id, diagonal, row_number() OVER (PARTITION BY stream_id ORDER BY count(*) DESC, diagonal) AS nth FROM once GROUP BY 1, 2) WHERE nth = 1)"""


@query(
    f"""WITH {_EIGHTS} SELECT stream_id, new_pos, old_pos FROM (SELECT a.stream_id, a.pos AS new_pos, b.pos AS old_pos,
        row_number() OVER (PARTITION BY a.stream_id, a.pos ORDER BY abs(b.pos - a.pos - coalesce(diagonal, 0)), b.pos) AS nth
        FROM a JOIN b ON a.stream_id = b.stream_id AND a.b = b.b LEFT JOIN usual ON a.stream_id = usual.stream_id) WHERE nth = 1"""
)
def nearest_block_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.nearest_matches(text_pairs(spark, sf_dir), 8)


# containers

_TAGGED = ("sections", "steps", "lite", "bsdiff", "endsley", "vcdiff")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, '{k}' AS found, doc_id AS stream_id FROM documents WHERE text IS NOT NULL" for k in _TAGGED))
def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container the tag of a diff names."""
    made = pairs.diffs(text_pairs(spark, sf_dir), list(_TAGGED))
    return made.select("kind", byte_ops.container_kind(F.col("diff")).alias("found"), "stream_id")


@query(
    " UNION ALL ".join(
        f"SELECT doc_id AS stream_id, '{k}' AS kind, 'zlib' AS packing, strlen(text) AS old_size, strlen({_NEW}) AS new_size FROM documents WHERE text IS NOT NULL" for k in ("sections", "steps", "lite")
    )
)
def container_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the heads of diffs tell."""
    made = pairs.diffs(text_pairs(spark, sf_dir), ["sections", "steps", "lite"]).select("stream_id", byte_ops.container_info(F.col("diff")).alias("i"))
    return made.select("stream_id", "i.kind", "i.packing", "i.old_size", "i.new_size")


@query(_APPLIED)
def resaved_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of one compressor saved under another, then applied."""
    from .catalog import _applied

    return _applied(pairs.resave(pairs.with_diff(text_pairs(spark, sf_dir), "sections", "zlib", "block"), "bz2"))


# files and directories


@query(
    f"""WITH {_LAYOUT}, contents AS (SELECT format('doc/{{:09d}}', doc_id) AS path, hex(text) AS h FROM documents WHERE text IS NOT NULL),
    parts AS (SELECT l.path, begin::BIGINT AS begin, size, h, unnest(range((begin // 4096)::BIGINT, ((begin + size - 1) // 4096 + 1)::BIGINT)) AS k FROM layout AS l JOIN contents AS c ON l.path = c.path WHERE size > 0),
    cut AS (SELECT path, h, greatest(begin, k * 4096) - begin AS "offset", least(begin + size, (k + 1) * 4096) - greatest(begin, k * 4096) AS length FROM parts)
    SELECT path, "offset"::BIGINT AS "offset", length::BIGINT AS length, md5(unhex(substr(h, (2 * "offset" + 1)::BIGINT, (2 * length)::BIGINT))) AS md5 FROM cut"""
)
def output_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential output of segments of 4,096 bytes, cut at the files in it."""
    layout = _layout(spark, sf_dir)
    placed = _files(spark, sf_dir, "old").join(layout, "path").where("size > 0")
    each = placed.select("begin", "end", "content", F.explode(F.sequence(F.floor(F.col("begin") / 4096), F.floor((F.col("end") - 1) / 4096))).alias("k"))
    first, last = F.greatest("begin", F.col("k") * 4096), F.least(F.col("end"), (F.col("k") + 1) * 4096)
    piece = F.substring("content", (first - F.col("begin") + 1).cast("int"), (last - first).cast("int"))
    # files begin at multiples of 16, with zero bytes between them
    room = F.when(last < F.col("end"), last).otherwise(F.least(F.ceil(F.col("end") / 16).cast("long") * 16, (F.col("k") + 1) * 4096))
    pieces = each.select("k", first.alias("at"), F.rpad(F.hex(piece), (2 * (room - first)).cast("int"), F.lit("0")).alias("hex"))
    segments = pieces.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "hex"))).alias("list"))
    stream = segments.select(F.col("list")[0]["at"].alias("pos"), F.unhex(F.array_join(F.transform("list", lambda p: p["hex"]), "")).alias("bytes"))
    return files.split_output(stream, layout).select("path", "offset", F.octet_length("bytes").cast("long").alias("length"), F.md5("bytes").alias("md5"))


_MANIFEST = """body AS (SELECT format('doc/{:09d}', doc_id) AS path, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)"""


@query(
    f"""WITH {_MANIFEST} SELECT 0::BIGINT AS line_no, '{manifests.VERSION}' AS value UNION ALL SELECT 1, 'ChecksumType:sha256'
    UNION ALL SELECT 2, 'Count:' || count(*) FROM body
    UNION ALL SELECT row_number() OVER (ORDER BY path) + 2, 'Path:' || regexp_replace(digest, '(.)(.)', '\\2\\1', 'g') || ':' || path FROM body"""
)
def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.manifest_lines(_files(spark, sf_dir, "old"))


@query(f"WITH {_MANIFEST} SELECT path, 'sha256' AS checksum_type, digest FROM body")
def manifest_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest text read again."""
    return manifests.parse_manifest(manifests.manifest_lines(_files(spark, sf_dir, "old")).select("value"))


@query(
    f"""WITH {_FILES}, sized AS (SELECT s.*, strlen(f.new) AS size FROM same AS s JOIN files AS f ON s.new_path = f.path)
    SELECT (SELECT count(*) FROM files) AS new_files, (SELECT count(*) FROM files) AS old_files, count(*) AS copies, coalesce(sum(size), 0)::BIGINT AS copied_bytes,
    (SELECT count(*) FROM files) - count(*) AS deltas FROM sized"""
)
def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _files(spark, sf_dir, "new"), _files(spark, sf_dir, "old")
    return directory.summary(directory.dir_diff(new, old), new, old).drop("diff_bytes")


_INDEXED = f"""WITH {_FILES}, numbered AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM files),
    paired AS (SELECT a.i AS new_index, b.i AS old_index FROM same JOIN numbered AS a ON new_path = a.path JOIN numbered AS b ON old_path = b.path)"""


@query(
    f"""{_INDEXED} SELECT row_number() OVER (ORDER BY new_index) - 1 AS index, new_index - coalesce(lag(new_index) OVER (ORDER BY new_index), -1) - 1 AS new_delta,
    old_index - coalesce(lag(old_index) OVER (ORDER BY new_index), -1) - 1 AS old_delta FROM paired"""
)
def same_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal files as differences of their numbers in either tree."""
    new, old = _files(spark, sf_dir, "new"), _files(spark, sf_dir, "old")
    a = files.numbered(new.select("path"), "path").select(F.col("path").alias("new_path"), F.col("index").alias("new_index"))
    b = files.numbered(old.select("path"), "path").select(F.col("path").alias("old_path"), F.col("index").alias("old_index"))
    same = files.same_files(new, old).join(a, "new_path").join(b, "old_path").select("new_index", "old_index")
    return files.same_pair_deltas(same)


@query(
    f"""{_INDEXED}, changed AS (SELECT i FROM numbered WHERE i NOT IN (SELECT new_index FROM paired))
    SELECT row_number() OVER (ORDER BY i) - 1 AS index, i - coalesce(lag(i) OVER (ORDER BY i), -1) - 1 AS delta FROM changed"""
)
def changed_index_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of new files without an equal old one, as differences."""
    new, old = _files(spark, sf_dir, "new"), _files(spark, sf_dir, "old")
    every = files.numbered(new.select("path"), "path").withColumnRenamed("index", "place")
    left = files.leftovers(every, F.col("new_path"), files.same_files(new, old)).select("place")
    return files.index_deltas(files.numbered(left, "place"), "place")


# sync


@query(_NEEDED.replace("TRUE AS ok, ", "").replace(" need_blocks\n", " given_blocks, md5(unhex(n)) AS made_md5\n"))
def sync_diff_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync diff as tables, made of old and new, applied to old."""
    both = text_pairs(spark, sf_dir)
    old, new = (both.select("stream_id", F.col(c).alias("content")) for c in ("old", "new"))
    codes, given = sync.local_diff(old, new, 256)
    signed, _ = sync.publish(new, 256)
    made = sync.local_patch(old, codes, given, signed, 256)
    parts = made.groupBy("stream_id").agg(F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_list(F.struct("block_index", F.hex("bytes").alias("hex")))).alias("parts"))
    whole = parts.select("stream_id", "blocks", F.md5(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))).alias("made_md5"))
    held = codes.where("kind = 'match'").groupBy("stream_id").agg(F.count(F.lit(1)).alias("held"))
    return whole.join(held, "stream_id", "left").select("stream_id", "blocks", (F.col("blocks") - F.coalesce("held", F.lit(0))).alias("given_blocks"), "made_md5")
