"""The registered queries and their SQL equivalents.

Byte streams are the texts of ``documents``.  The new version of a text is the
same expression in both engines: a word put in front and forty characters cut
out behind the three-hundredth, for texts of 512 characters or more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums
from ..operators import blocks, bytes as byte_ops, covers, files, pairs
from . import directory, sync

B = 64
IGNORE = "*.html#en/#top"
FLAGSHIP = "patched_text"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query by its function's name, with its SQL if there is any."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def old_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("content"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    changed = F.concat(F.lit("INSERTED "), F.substring("text", 1, 300), F.expr("substring(text, 341)"))
    new = F.when(F.char_length("text") >= 512, changed).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("stream_id"), F.encode("text", "UTF-8").alias("old"), F.encode(new, "UTF-8").alias("new"))


def pair_sizes(both: DataFrame) -> DataFrame:
    return both.select("stream_id", F.octet_length("old").cast("long").alias("old_size"), F.octet_length("new").cast("long").alias("new_size"))


def sync_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.sync_positions(text_pairs(spark, sf_dir), B)


def sync_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sync_rows(spark, sf_dir).where("old_pos IS NOT NULL")
    return covers.merge_touching(found.select("stream_id", "old_pos", "new_pos", "length"))


# SQL that the equivalents share.  Texts are hex digits, two for a byte; windows
# are cut out of pieces of 1 KiB so that no engine searches long strings.

_NEW = "CASE WHEN length(text) >= 512 THEN 'INSERTED ' || substring(text, 1, 300) || substring(text, 341) ELSE text END"
_STREAMS = "streams AS (SELECT doc_id AS stream_id, hex(text) AS h, strlen(text) AS size FROM documents WHERE text IS NOT NULL)"
_PAIRS = f"""pairs AS (SELECT doc_id AS stream_id, hex(text) AS o, strlen(text) AS old_size, hex({_NEW}) AS n, strlen({_NEW}) AS new_size
    FROM documents WHERE text IS NOT NULL)"""


def _windows(name: str, column: str, size: str, block: int = B) -> str:
    return f"""{name}_pieces AS (SELECT stream_id, c * 1024 AS base, substr({column}, 2048 * c + 1, 2048 + {2 * block - 2}) AS piece
        FROM (SELECT stream_id, {column}, unnest(range(0, ({size} + 1023) // 1024)) AS c FROM pairs)),
    {name} AS (SELECT stream_id, md5(w) AS h, min(pos) AS pos FROM (
        SELECT stream_id, base + i AS pos, substr(piece, 2 * i + 1, {2 * block}) AS w
        FROM (SELECT stream_id, base, piece, unnest(range(0, least(1024, len(piece) // 2 - {block - 1}))) AS i FROM {name}_pieces)) GROUP BY 1, 2)"""


def _whole_blocks(name: str, column: str, size: str, block: int = B) -> str:
    return f"""{name} AS (SELECT stream_id, k AS block_index, k * {block} AS pos, md5(substr({column}, {2 * block} * k + 1, {2 * block})) AS h
        FROM (SELECT stream_id, {column}, unnest(range(0, {size} // {block})) AS k FROM pairs))"""


_SYNC = f"""{_PAIRS}, {_windows("old_windows", "o", "old_size")}, {_whole_blocks("new_blocks", "n", "new_size")},
    sync AS (SELECT b.stream_id, b.block_index, b.pos AS new_pos, {B}::BIGINT AS length, w.pos AS old_pos
        FROM new_blocks AS b LEFT JOIN old_windows AS w ON b.stream_id = w.stream_id AND b.h = w.h)"""
_COVERS = f"""{_SYNC},
    marked AS (SELECT *, CASE WHEN lag(new_pos) OVER o = new_pos - {B} AND lag(old_pos) OVER o = old_pos - {B} THEN 0 ELSE 1 END AS head
        FROM sync WHERE old_pos IS NOT NULL WINDOW o AS (PARTITION BY stream_id ORDER BY new_pos)),
    covers AS (SELECT stream_id, min(old_pos)::BIGINT AS old_pos, min(new_pos)::BIGINT AS new_pos, sum(length)::BIGINT AS length
        FROM (SELECT *, sum(head) OVER (PARTITION BY stream_id ORDER BY new_pos) AS island FROM marked) GROUP BY stream_id, island)"""


def _varint(value: str, tag: int = 0) -> str:
    return "(CASE " + " ".join(f"WHEN {value} < {1 << (7 * k - tag)} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)"


_RUNS = f"""{_STREAMS},
    parts AS (SELECT stream_id, c * 1024 AS base, substr(h, 2048 * c + 1, 2048) AS piece FROM (SELECT stream_id, h, unnest(range(0, (size + 1023) // 1024)) AS c FROM streams)),
    bytes AS (SELECT stream_id, base + j AS pos, ('0x' || substr(piece, 2 * j + 1, 2))::BIGINT AS value
        FROM (SELECT stream_id, base, piece, unnest(range(0, len(piece) // 2)) AS j FROM parts)),
    heads AS (SELECT stream_id, pos, value, lead(pos) OVER (PARTITION BY stream_id ORDER BY pos) AS next_pos FROM (
        SELECT *, lag(value) OVER (PARTITION BY stream_id ORDER BY pos) AS before FROM bytes) WHERE before IS DISTINCT FROM value),
    runs AS (SELECT r.stream_id, pos, value, coalesce(next_pos, size) - pos AS length FROM heads AS r JOIN streams AS s ON r.stream_id = s.stream_id)"""
_BLOCKS = f"""{_STREAMS}, blocks AS (SELECT stream_id, k AS block_index, k * {B} AS pos, substr(h, {2 * B} * k + 1, {2 * B}) AS b
    FROM (SELECT stream_id, h, unnest(range(0, (size + {B - 1}) // {B})) AS k FROM streams))"""
_SIGNED = f"""{_BLOCKS}, signed AS (SELECT stream_id, block_index, pos, (len(b) // 2)::BIGINT AS length, md5(unhex(rpad(b, {2 * B}, '0'))) AS strong FROM blocks)"""


# blocks and checksums


@query(f"WITH {_BLOCKS} SELECT stream_id, block_index, pos, (len(b) // 2)::BIGINT AS length, md5(unhex(b)) AS md5 FROM blocks")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.split_blocks(old_streams(spark, sf_dir), B)
    return found.select("stream_id", "block_index", "pos", F.octet_length("block").cast("long").alias("length"), F.md5("block").alias("md5"))


@query(f"WITH {_SIGNED} SELECT * FROM signed")
def block_md5_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.signatures(old_streams(spark, sf_dir), B)


def _sums_sql(value: str, base: int, initial: int) -> str:
    v = f"list_transform(range(0, len(b) // 2), lambda j: {value})"
    return f"""WITH {_BLOCKS}, listed AS (SELECT stream_id, block_index, {v} AS v FROM blocks)
        SELECT stream_id, block_index, (({initial} + list_sum(v)) % {base})::BIGINT AS a,
               (({initial} * len(v) + list_sum(list_transform(range(0, len(v)), lambda j: (len(v) - j) * v[j + 1]))) % {base})::BIGINT AS s FROM listed"""


_BYTE = "('0x' || substr(b, 2 * j + 1, 2))::BIGINT"


def _sums(spark: SparkSession, sf_dir: str, make: Callable) -> DataFrame:
    found = blocks.split_blocks(old_streams(spark, sf_dir), B).select("stream_id", "block_index", make(F.col("block")).alias("sums"))
    return found.select("stream_id", "block_index", "sums.a", "sums.s")


@query(_sums_sql(_BYTE, checksums.BASE_16, 1))
def block_adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, checksums.adler32)


@query(_sums_sql(_BYTE, checksums.BASE_32, 1))
def block_adler64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, checksums.adler64)


@query(_sums_sql(f"(({_BYTE} + 1) * 2654435761) % 4294967296", 1 << 32, 1))
def block_fadler64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, checksums.fadler64)


@query(_sums_sql(_BYTE, checksums.BASE_ZSYNC, 0))
def block_zsync_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, checksums.zsync_roll)


# sums over rows of bytes: the window that ends at a byte has its sum and its sum by place
_ROLLED = f"""WITH {_RUNS}, valued AS (SELECT stream_id, pos, ((value + 1) * 2654435761) % 4294967296 AS t FROM bytes),
    summed AS (SELECT stream_id, pos, sum(t) OVER w AS d, sum(t * pos) OVER w AS by_place FROM valued
        WINDOW w AS (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN {B - 1} PRECEDING AND CURRENT ROW)),
    rolled AS (SELECT stream_id, ((1 + d) % 4294967296 + (({B} + (pos + 1) * d - by_place) % 2147483648) * 4294967296)::BIGINT AS v
        FROM summed WHERE pos >= {B - 1})
    SELECT stream_id, count(*) AS windows, min(v) AS low, max(v) AS high, bit_xor(v) AS "check" FROM rolled GROUP BY stream_id"""


@query(_ROLLED)
def roll_hash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ops.window_sums(old_streams(spark, sf_dir), B)


@query(
    f"""WITH {_SIGNED}, cut AS (SELECT DISTINCT strong, ('0x' || substr(strong, 1, 8))::BIGINT AS h FROM signed),
    each AS (SELECT bits, h % (1::BIGINT << bits) AS h FROM cut, (SELECT unnest([8, 16, 24, 32]) AS bits))
    SELECT bits, count(*) AS windows, count(DISTINCT h) AS distinct_values, count(*) - count(DISTINCT h) AS clashes FROM each GROUP BY bits"""
)
def clash_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = blocks.signatures(old_streams(spark, sf_dir), B).select("strong").distinct()
    return blocks.clash_counts(strong.select(F.conv(F.substring("strong", 1, 8), 16, 10).cast("long").alias("h")), [8, 16, 24, 32])


@query(
    f"""WITH {_SIGNED} SELECT stream_id, block_index, same_index FROM (SELECT stream_id, block_index,
    lag(block_index) OVER (PARTITION BY stream_id, strong ORDER BY block_index) AS same_index FROM signed) WHERE same_index IS NOT NULL"""
)
def same_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.earlier_same_blocks(blocks.signatures(old_streams(spark, sf_dir), B))


@query(
    f"""WITH {_SIGNED} SELECT strong, count(DISTINCT stream_id) AS streams, count(*) AS blocks, min(stream_id) AS first_stream
    FROM signed GROUP BY strong HAVING count(DISTINCT stream_id) > 1"""
)
def shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.shared_blocks(blocks.signatures(old_streams(spark, sf_dir), B))


@query(
    f"""WITH {_SIGNED} SELECT stream_id, count(*) AS blocks,
    bit_xor(('0x' || substr(md5(block_index || ':' || strong), 1, 15))::BIGINT) AS "check" FROM signed GROUP BY stream_id"""
)
def xor_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.xor_check(blocks.signatures(old_streams(spark, sf_dir), B))


@query(
    f"""WITH {_PAIRS}, {_whole_blocks("new_blocks", "n", "new_size")}, {_whole_blocks("old_blocks", "o", "old_size")},
    a AS (SELECT *, lead(h) OVER (PARTITION BY stream_id ORDER BY block_index) AS h2 FROM new_blocks),
    b AS (SELECT *, lead(h) OVER (PARTITION BY stream_id ORDER BY block_index) AS h2 FROM old_blocks)
    SELECT a.stream_id, a.block_index, min(b.block_index) AS old_index FROM a JOIN b ON a.stream_id = b.stream_id AND a.h = b.h AND a.h2 = b.h2
    GROUP BY a.stream_id, a.block_index"""
)
def seq_match_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.sequential_matches(text_pairs(spark, sf_dir), B)


# matching


@query(f"WITH {_SYNC} SELECT * FROM sync")
def sync_match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_rows(spark, sf_dir)


@query(
    f"""WITH {_PAIRS}, {_windows("new_windows", "n", "new_size")}, {_whole_blocks("old_blocks", "o", "old_size")}
    SELECT b.stream_id, b.block_index AS old_index, b.pos AS old_pos, w.pos AS new_pos
    FROM old_blocks AS b JOIN new_windows AS w ON b.stream_id = w.stream_id AND b.h = w.h"""
)
def sign_match_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.sign_positions(text_pairs(spark, sf_dir), B)


@query(
    f"""WITH {_PAIRS}, {_whole_blocks("old_blocks", "o", "old_size")},
    first_blocks AS (SELECT stream_id, h, min(pos) AS old_pos FROM old_blocks GROUP BY 1, 2),
    pieces AS (SELECT stream_id, c * 1024 AS base, substr(n, 2048 * c + 1, 2048 + {2 * B - 2}) AS piece
        FROM (SELECT stream_id, n, unnest(range(0, (new_size + 1023) // 1024)) AS c FROM pairs)),
    hits AS (SELECT w.stream_id, old_pos, w.pos AS new_pos, w.pos - old_pos AS diagonal FROM (
        SELECT stream_id, base + i AS pos, md5(substr(piece, 2 * i + 1, {2 * B})) AS h
        FROM (SELECT stream_id, base, piece, unnest(range(0, least(1024, len(piece) // 2 - {B - 1}))) AS i FROM pieces)) AS w
        JOIN first_blocks AS f ON w.stream_id = f.stream_id AND w.h = f.h),
    marked AS (SELECT *, CASE WHEN new_pos - lag(new_pos) OVER (PARTITION BY stream_id, diagonal ORDER BY new_pos) <= {B} THEN 0 ELSE 1 END AS head FROM hits),
    islands AS (SELECT *, sum(head) OVER (PARTITION BY stream_id, diagonal ORDER BY new_pos) AS island FROM marked)
    SELECT stream_id, min(old_pos) AS old_pos, min(new_pos) AS new_pos, max(new_pos) + {B} - min(new_pos) AS length FROM islands GROUP BY stream_id, diagonal, island"""
)
def block_match_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.diagonal_islands(pairs.candidate_covers(text_pairs(spark, sf_dir), B))


@query(f"WITH {_SYNC} SELECT stream_id, block_index, new_pos, length FROM sync WHERE old_pos IS NULL")
def need_sync_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.needed_blocks(sync_rows(spark, sf_dir))


@query(
    f"""WITH {_SYNC} SELECT stream_id, min(new_pos) AS first_byte, max(new_pos + length - 1) AS last_byte, count(*) AS blocks FROM (
    SELECT *, block_index - row_number() OVER (PARTITION BY stream_id ORDER BY block_index) AS island FROM sync WHERE old_pos IS NULL) GROUP BY stream_id, island"""
)
def need_sync_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.needed_ranges(sync_rows(spark, sf_dir))


@query(
    f"""WITH {_SYNC} SELECT stream_id, count(*) AS blocks, count(*) FILTER (old_pos IS NULL) AS need_blocks,
    coalesce(sum(length) FILTER (old_pos IS NULL), 0)::BIGINT AS need_bytes FROM sync GROUP BY stream_id"""
)
def need_sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.sync_summary(sync_rows(spark, sf_dir))


@query(
    f"""WITH {_SYNC}, marked AS (SELECT *, max_by(old_pos + length, block_index) FILTER (old_pos IS NOT NULL)
        OVER (PARTITION BY stream_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_end FROM sync)
    SELECT stream_id, block_index AS at, 'match' AS kind, old_pos - coalesce(last_end, 0) AS value, 1::BIGINT AS blocks FROM marked WHERE old_pos IS NOT NULL
    UNION ALL
    SELECT stream_id, min(block_index), 'miss', count(*), count(*) FROM (
        SELECT *, (row_number() OVER (PARTITION BY stream_id, island ORDER BY block_index) - 1) // 2048 AS part FROM (
            SELECT *, block_index - row_number() OVER (PARTITION BY stream_id ORDER BY block_index) AS island FROM sync WHERE old_pos IS NULL))
    GROUP BY stream_id, island, part"""
)
def sync_position_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.position_codes(sync_rows(spark, sf_dir))


# covers


@query(f"WITH {_COVERS} SELECT * FROM covers")
def touching_cover_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_covers(spark, sf_dir)


@query(
    f"""WITH {_COVERS}, ends AS (SELECT stream_id, new_pos, length FROM covers UNION ALL SELECT stream_id, new_size, 0 FROM pairs)
    SELECT stream_id, pos, new_pos - pos AS length FROM (
        SELECT *, coalesce(lag(new_pos + length) OVER (PARTITION BY stream_id ORDER BY new_pos, length), 0) AS pos FROM ends) WHERE new_pos > pos"""
)
def literal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.gaps(sync_covers(spark, sf_dir), pair_sizes(text_pairs(spark, sf_dir)))


@query(
    f"""WITH {_COVERS}, spans AS (SELECT stream_id, old_pos AS begin, old_pos + length AS stop FROM covers UNION ALL SELECT stream_id, old_size, old_size FROM pairs)
    SELECT stream_id, pos, begin - pos AS length FROM (SELECT *, coalesce(max(stop) OVER (PARTITION BY stream_id ORDER BY begin, stop
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM spans) WHERE begin - pos >= 16"""
)
def cover_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.old_complement(sync_covers(spark, sf_dir), pair_sizes(text_pairs(spark, sf_dir)))


_DELTAS = f"""{_COVERS}, deltas AS (SELECT stream_id, new_pos, old_pos - coalesce(lag(old_pos + length) OVER o, 0) AS old_delta,
    new_pos - coalesce(lag(new_pos + length) OVER o, 0) AS new_gap, length FROM covers WINDOW o AS (PARTITION BY stream_id ORDER BY new_pos))"""


@query(f"WITH {_DELTAS} SELECT * FROM deltas")
def cover_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.encode_deltas(sync_covers(spark, sf_dir))


@query(f"WITH {_COVERS} SELECT * FROM covers")
def cover_positions_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.decode_deltas(covers.encode_deltas(sync_covers(spark, sf_dir)), "new_pos")


@query(
    f"""WITH {_DELTAS} SELECT stream_id, count(*) AS covers,
    sum({_varint("abs(old_delta)", 1)} + {_varint("new_gap")} + {_varint("length")})::BIGINT AS control_bytes FROM deltas GROUP BY stream_id"""
)
def cover_control_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.control_cost(covers.encode_deltas(sync_covers(spark, sf_dir)))


@query(
    f"""WITH {_COVERS} SELECT p.stream_id, p.old_size, p.new_size, count(c.length) AS covers, coalesce(sum(c.length), 0)::BIGINT AS covered,
    coalesce(max(c.length), 0)::BIGINT AS longest, p.new_size - coalesce(sum(c.length), 0)::BIGINT AS literal
    FROM pairs AS p LEFT JOIN covers AS c ON p.stream_id = c.stream_id GROUP BY p.stream_id, p.old_size, p.new_size"""
)
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.summary(sync_covers(spark, sf_dir), pair_sizes(text_pairs(spark, sf_dir)))


@query(f"WITH {_COVERS} SELECT sum(new_size)::BIGINT AS new_bytes, (sum(new_size) - (SELECT sum(length) FROM covers))::BIGINT AS literal_bytes FROM pairs")
def literal_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covers.summary(sync_covers(spark, sf_dir), pair_sizes(text_pairs(spark, sf_dir)))
    return found.agg(F.sum("new_size").alias("new_bytes"), F.sum("literal").alias("literal_bytes"))


@query(f"WITH {_COVERS} SELECT stream_id, greatest(max(new_pos - old_pos), 0)::BIGINT AS extra FROM covers GROUP BY stream_id")
def inplace_min_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.in_place_extra(sync_covers(spark, sf_dir))


@query(f"WITH {_COVERS} SELECT stream_id, old_pos, new_pos, length FROM covers WHERE old_pos + 256 >= new_pos")
def inplace_safe_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_covers(spark, sf_dir).where("old_pos + 256 >= new_pos")


@query(
    f"""WITH {_COVERS}, pieces AS (SELECT *, unnest(range(0, length, 1000)) AS begin FROM covers)
    SELECT stream_id, old_pos + begin AS old_pos, new_pos + begin AS new_pos, least(1000, length - begin) AS length FROM pieces"""
)
def cover_length_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.cut_long(sync_covers(spark, sf_dir), 1000)


@query(
    f"""WITH {_COVERS}, upto AS (SELECT stream_id, length, sum(length) OVER (PARTITION BY stream_id ORDER BY length) AS total FROM covers)
    SELECT stream_id, max(length)::BIGINT AS longest, max(total)::BIGINT AS cached FROM upto WHERE total <= 4096 GROUP BY stream_id"""
)
def cover_cache_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.fitting_cache(sync_covers(spark, sf_dir), 4096)


@query(
    f"""WITH {_COVERS}, all_covers AS (SELECT stream_id, old_pos, new_pos, length FROM covers
    UNION ALL SELECT stream_id, 0, 0, 0 FROM pairs WHERE stream_id NOT IN (SELECT stream_id FROM covers WHERE old_pos = 0 AND new_pos = 0)
    UNION ALL SELECT p.stream_id, coalesce(e.stop, 0), p.new_size, 0 FROM pairs AS p
        LEFT JOIN (SELECT stream_id, max_by(old_pos + length, new_pos) AS stop FROM covers GROUP BY 1) AS e ON p.stream_id = e.stream_id)
    SELECT stream_id, old_pos::BIGINT AS old_pos, new_pos::BIGINT AS new_pos, length::BIGINT AS length FROM all_covers"""
)
def cover_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.with_sentinels(sync_covers(spark, sf_dir), pair_sizes(text_pairs(spark, sf_dir)))


@query(
    f"""WITH {_COVERS}, damaged AS (SELECT stream_id, old_pos, new_pos, length FROM covers
    UNION ALL SELECT stream_id, old_pos, new_pos + 1, 0 FROM covers
    UNION ALL SELECT stream_id, old_pos - 5000, new_pos, length FROM covers
    UNION ALL SELECT stream_id, old_pos, new_pos + length // 2, length FROM covers),
    placed AS (SELECT *, coalesce(max(new_pos + length) OVER (PARTITION BY stream_id ORDER BY new_pos, length, old_pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM damaged)
    SELECT d.stream_id, old_pos, new_pos, length FROM placed AS d JOIN pairs AS p ON d.stream_id = p.stream_id
    WHERE length <= 0 OR old_pos < 0 OR new_pos < before OR old_pos + length > old_size OR new_pos + length > new_size"""
)
def cover_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers with damaged ones among them: empty, out of bounds, overlapping."""
    good = sync_covers(spark, sf_dir)
    rows = lambda old, new, n: good.select("stream_id", F.expr(old).alias("old_pos"), F.expr(new).alias("new_pos"), F.expr(n).alias("length"))
    damaged = good.select("stream_id", "old_pos", "new_pos", "length")
    for way in (("old_pos", "new_pos + 1", "0L"), ("old_pos - 5000", "new_pos", "length"), ("old_pos", "new_pos + floor(length / 2)", "length")):
        damaged = damaged.unionByName(rows(*way))
    return covers.violations(damaged, pair_sizes(text_pairs(spark, sf_dir)))


@query(f"SELECT doc_id AS stream_id, md5({_NEW}) AS made_md5, TRUE AS ok FROM documents WHERE text IS NOT NULL")
def patched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_pairs(spark, sf_dir)
    made = pairs.rebuild(both, sync_covers(spark, sf_dir))
    joined = made.join(both.select("stream_id", "new"), "stream_id")
    return joined.select("stream_id", F.md5("made").alias("made_md5"), (F.col("made") == F.col("new")).alias("ok"))


@query(f"SELECT doc_id AS stream_id, {_NEW} = text AS equal, strlen({_NEW}) = strlen(text) AS equal_size FROM documents WHERE text IS NOT NULL")
def stream_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_pairs(spark, sf_dir)
    return both.select("stream_id", (F.col("old") == F.col("new")).alias("equal"), (F.octet_length("old") == F.octet_length("new")).alias("equal_size"))


# bytes


@query(f"WITH {_RUNS} SELECT stream_id, pos, value, length FROM runs WHERE length >= 3")
def byte_rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ops.runs(old_streams(spark, sf_dir)).where("length >= 3")


@query(
    f"""WITH {_RUNS} SELECT stream_id, sum(CASE WHEN pos = 0 AND value = 0 THEN 0 WHEN value IN (0, 255) OR length = 1 THEN 1 ELSE 2 END)::BIGINT AS cost FROM runs GROUP BY stream_id"""
)
def region_rle_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ops.region_cost(old_streams(spark, sf_dir))


@query(
    f"""WITH {_RUNS} SELECT value AS first, next_value AS second, count(*) AS n FROM (
    SELECT value, lead(value) OVER (PARTITION BY stream_id ORDER BY pos) AS next_value FROM bytes) WHERE next_value IS NOT NULL GROUP BY 1, 2"""
)
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ops.bigram_counts(old_streams(spark, sf_dir))


_BOTH_BYTES = f"""{_PAIRS}, cut AS (SELECT stream_id, c, substr(o, 2048 * c + 1, 2048) AS a, substr(n, 2048 * c + 1, 2048) AS b
    FROM (SELECT stream_id, o, n, unnest(range(0, (least(old_size, new_size) + 1023) // 1024)) AS c FROM pairs)),
    difference AS (SELECT stream_id, c * 1024 + j AS pos,
        ((('0x' || substr(b, 2 * j + 1, 2))::BIGINT - ('0x' || substr(a, 2 * j + 1, 2))::BIGINT) + 256) % 256 AS d
        FROM (SELECT stream_id, c, a, b, unnest(range(0, least(len(a), len(b)) // 2)) AS j FROM cut))"""


@query(f"WITH {_BOTH_BYTES} SELECT stream_id, count(*) AS bytes, count(*) FILTER (d = 0) AS zeros, sum(d * (pos % 251 + 1))::BIGINT AS weighed FROM difference GROUP BY stream_id")
def sub_diff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_pairs(spark, sf_dir)
    found = both.select("stream_id", byte_ops.byte_sums(byte_ops.subtract(F.col("new"), F.col("old"))).alias("s"))
    return found.where("s.bytes > 0").select("stream_id", "s.bytes", "s.zeros", "s.weighed")


@query(
    f"""WITH {_BOTH_BYTES}, heads AS (SELECT stream_id, pos, d = 0 AS zero, lag(d = 0) OVER (PARTITION BY stream_id ORDER BY pos) AS before FROM difference),
    runs AS (SELECT stream_id, pos, zero, lead(pos) OVER (PARTITION BY stream_id ORDER BY pos) AS next_pos FROM heads WHERE before IS DISTINCT FROM zero),
    sized AS (SELECT r.stream_id, pos, zero, coalesce(next_pos, least(old_size, new_size)) - pos AS length FROM runs AS r JOIN pairs AS p ON r.stream_id = p.stream_id),
    paired AS (SELECT *, lag(zero) OVER o AS after_zero, lag(length) OVER o AS before_length, lead(zero) OVER o AS next_zero FROM sized WINDOW o AS (PARTITION BY stream_id ORDER BY pos))
    SELECT stream_id, CASE WHEN zero OR after_zero IS NULL THEN pos ELSE pos - before_length END AS pos,
           CASE WHEN zero THEN length WHEN after_zero THEN before_length ELSE 0 END AS zeros, CASE WHEN zero THEN 0 ELSE length END AS others
    FROM paired WHERE NOT zero OR next_zero IS NULL"""
)
def rle0_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_pairs(spark, sf_dir)
    return byte_ops.zero_runs(both.select("stream_id", byte_ops.subtract(F.col("new"), F.col("old")).alias("content")))


@query(
    f"""SELECT doc_id AS stream_id, {_varint("strlen(text)")} AS plain, {_varint("strlen(text)", 2)} AS tagged,
    {_varint("(strlen(text) * 1000003)")} AS large FROM documents WHERE text IS NOT NULL"""
)
def varint_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("content").cast("long")
    found = old_streams(spark, sf_dir).select("stream_id", size.alias("n"))
    return found.select("stream_id", covers.varint_size(F.col("n")).alias("plain"), covers.varint_size(F.col("n"), 2).alias("tagged"), covers.varint_size(F.col("n") * 1000003).alias("large"))


# files: pages by URL path, documents as files


@query(
    """SELECT page_id, url, regexp_matches(replace(url, '\\', '/'), '(?:^|/)[^/]*\\.html(?:/|$)|(?:^|/)en/|(?:^|/)top(?:/|$)') AS ignored FROM pages WHERE url IS NOT NULL"""
)
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return found.select("page_id", "url", files.ignored(F.col("url"), IGNORE).alias("ignored"))


@query("SELECT url AS path, strlen(html) AS size, md5(html) AS md5, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def manifest_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    digests = (checksums.digest(k, F.col("content")).alias(k) for k in ("md5", "sha256"))
    return found.select("path", F.octet_length("content").cast("long").alias("size"), *digests)


def _files(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    path = F.format_string("doc/%09d", "stream_id")
    return text_pairs(spark, sf_dir).select(path.alias("path"), F.col(side).alias("content"))


_FILES = f"""files AS (SELECT format('doc/{{:09d}}', doc_id) AS path, text AS old, {_NEW} AS new FROM documents WHERE text IS NOT NULL),
    least_old AS (SELECT old, min(path) AS old_path FROM files WHERE old <> '' GROUP BY old),
    same AS (SELECT f.path AS new_path, CASE WHEN f.old = f.new THEN f.path ELSE l.old_path END AS old_path FROM files AS f JOIN least_old AS l ON f.new = l.old)"""


@query(f"WITH {_FILES} SELECT * FROM same")
def same_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.same_files(_files(spark, sf_dir, "new"), _files(spark, sf_dir, "old"))


@query(
    f"""WITH {_FILES} SELECT path, 'new' AS side FROM files WHERE path NOT IN (SELECT new_path FROM same)
    UNION ALL SELECT path, 'old' FROM files WHERE path NOT IN (SELECT old_path FROM same)"""
)
def unmatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _files(spark, sf_dir, "new"), _files(spark, sf_dir, "old")
    same = files.same_files(new, old)
    left = files.leftovers(new.select("path"), F.col("new_path"), same).withColumn("side", F.lit("new"))
    return left.unionByName(files.leftovers(old.select("path"), F.col("old_path"), same).withColumn("side", F.lit("old")))


_LAYOUT = """layout AS (SELECT path, size, sum(room) OVER (ORDER BY path) - room AS begin FROM (
    SELECT format('doc/{:09d}', doc_id) AS path, strlen(text) AS size, (strlen(text) + 15) // 16 * 16 AS room FROM documents WHERE text IS NOT NULL))"""


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _files(spark, sf_dir, "old").select("path", F.octet_length("content").cast("long").alias("size"))
    return files.ref_stream_by_range(sized, "path", 16)


@query(f'WITH {_LAYOUT} SELECT path, size, begin::BIGINT AS begin, (begin + size)::BIGINT AS "end" FROM layout')
def ref_stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout(spark, sf_dir)


@query(
    f"""WITH {_LAYOUT}, asked AS (SELECT (doc_id * 1009)::BIGINT AS pos FROM documents WHERE doc_id IS NOT NULL)
    SELECT pos, path, (pos - begin)::BIGINT AS "offset" FROM asked JOIN layout ON pos >= begin AND pos < begin + size"""
)
def position_to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select((F.col("doc_id") * 1009).cast("long").alias("pos"))
    return files.at_positions(asked, _layout(spark, sf_dir))


@query(
    f"""WITH {_FILES}, a AS (SELECT path, sha256(new) AS n FROM files),
    b AS (SELECT CASE WHEN old = new THEN path ELSE replace(path, 'doc/', 'old/') END AS path, sha256(old) AS o FROM files)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' WHEN n <> o THEN 'changed' ELSE 'same' END AS change
    FROM a FULL JOIN b ON a.path = b.path
    UNION ALL
    SELECT path, CASE WHEN old <> new THEN 'changed' ELSE 'same' END FROM files"""
)
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both whole trees, twice: an old tree whose changed files stood elsewhere,
    so that files are added and removed, and one in which all kept their paths."""
    both = text_pairs(spark, sf_dir)
    new, old = (files.with_digest(_files(spark, sf_dir, side)) for side in ("new", "old"))
    changed = both.where("old <> new").select(F.format_string("doc/%09d", "stream_id").alias("path"), F.lit(True).alias("moved"))
    moved = old.join(changed, "path", "left").withColumn("path", F.when(F.col("moved"), F.replace("path", F.lit("doc/"), F.lit("old/"))).otherwise(F.col("path"))).drop("moved")
    return files.manifest_diff(new, moved).unionByName(files.manifest_diff(new, old))


@query(
    f"""WITH {_RUNS}, begins AS (SELECT stream_id, sum(size) OVER (ORDER BY stream_id) - size AS begin FROM streams),
    total AS (SELECT sum(size) AS n FROM streams)
    SELECT ((1 + sum(value)) % 65521)::BIGINT AS a, ((any_value(n) + sum((n - begin - pos) * value)) % 65521)::BIGINT AS s
    FROM bytes JOIN begins USING (stream_id), total"""
)
def combined_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adler 32 of all documents end to end, combined from each one's."""
    sums = old_streams(spark, sf_dir).select("stream_id", F.octet_length("content").alias("size"), checksums.adler32(F.col("content")).alias("sums"))
    return files.combined_sums(sums.select(F.col("stream_id").alias("path"), "sums.a", "sums.s", "size"), checksums.BASE_16)


# whole operations, by round trip


_APPLIED = f"SELECT doc_id AS stream_id, strlen({_NEW}) AS new_size, md5({_NEW}) AS made_md5, TRUE AS ok FROM documents WHERE text IS NOT NULL"


def _applied(made: DataFrame) -> DataFrame:
    """(stream_id, new_size, made_md5, ok): what diffs beside their pairs make of
    old, and whether it is new."""
    back = made.withColumn("made", pairs.patched(F.col("old"), F.col("diff"), F.col("new_size")))
    return back.select("stream_id", "new_size", F.md5("made").alias("made_md5"), (F.col("made") == F.col("new")).alias("ok"))


def _roundtrip(spark: SparkSession, sf_dir: str, kind: str, packing: str, finder: str) -> DataFrame:
    return _applied(pairs.with_diff(text_pairs(spark, sf_dir), kind, packing, finder))


def _register_roundtrips() -> None:
    for name, kind, packing in (
        ("plain_roundtrip", "plain", ""),
        ("sections_roundtrip", "sections", "zlib"),
        ("steps_roundtrip", "steps", "zlib"),
        ("lite_roundtrip", "lite", "zlib"),
        ("bsdiff_roundtrip", "bsdiff", ""),
        ("endsley_roundtrip", "endsley", ""),
        ("vcdiff_roundtrip", "vcdiff", ""),
    ):
        QUERIES[name] = lambda spark, sf_dir, k=kind, p=packing: _roundtrip(spark, sf_dir, k, p, "block")
        ORACLE_SQL[name] = _APPLIED


_register_roundtrips()


@query()
def longest_match_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_covers(text_pairs(spark, sf_dir), "longest")


@query()
def selected_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_covers(text_pairs(spark, sf_dir), "selected")


@query()
def extended_block_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_covers(text_pairs(spark, sf_dir), "block")


@query()
def block_then_longest_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_covers(text_pairs(spark, sf_dir), "mixed")


@query()
def step_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.find_steps(text_pairs(spark, sf_dir), "block", 4096)
    return found.select("stream_id", "step_no", "first_new", "cover_bytes", F.octet_length("literal").cast("long").alias("literal_bytes"))


# an order-one model that counts the blocks of 4,096 bytes before; no text here reaches its window
@query(
    f"""WITH {_RUNS}, paired AS (SELECT stream_id, pos // 4096 AS part, coalesce(lag(value) OVER (PARTITION BY stream_id ORDER BY pos), 0) AS before, value FROM bytes),
    pair_counts AS (SELECT stream_id, before, value, part, count(*) AS n FROM paired GROUP BY ALL),
    single_counts AS (SELECT stream_id, before, part, count(*) AS n FROM paired GROUP BY ALL),
    pairs_upto AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stream_id, before, value ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM pair_counts),
    singles_upto AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stream_id, before ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM single_counts),
    bits AS (SELECT p.stream_id, -sum(p.n * log2((p.seen + 1 / 256) / (s.seen + 1))) AS bits FROM pairs_upto AS p
        JOIN singles_upto AS s ON p.stream_id = s.stream_id AND p.before = s.before AND p.part = s.part GROUP BY p.stream_id)
    SELECT stream_id, ceil(coalesce(bits, 0) / 8)::BIGINT AS cost FROM streams LEFT JOIN bits USING (stream_id)"""
)
def adaptive_bigram_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_ops.recent_bigram_cost(old_streams(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, CASE WHEN path IN (SELECT new_path FROM same) THEN 'copy' ELSE 'delta' END AS action, TRUE AS ok FROM files")
def dir_diff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _files(spark, sf_dir, "new"), _files(spark, sf_dir, "old")
    changes = directory.dir_diff(new, old)
    made = directory.dir_patch(changes, old)
    return made.join(changes.select("path", "action"), "path").select("path", "action", "ok")


_NEEDED = f"""WITH {_PAIRS}, {_windows("old_windows", "o", "old_size", 256)}, {_whole_blocks("new_blocks", "n", "new_size", 256)},
    found AS (SELECT b.stream_id, count(*) AS held FROM new_blocks AS b JOIN old_windows AS w ON b.stream_id = w.stream_id AND b.h = w.h GROUP BY 1)
    SELECT stream_id, TRUE AS ok, (new_size + 255) // 256 AS blocks, (new_size + 255) // 256 - coalesce(held, 0) AS need_blocks
    FROM pairs LEFT JOIN found USING (stream_id) WHERE new_size > 0"""


@query(_NEEDED)
def sync_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_pairs(spark, sf_dir)
    side = lambda name: both.select("stream_id", F.col(name).alias("content"))
    return sync.synchronise(side("old"), side("new"), 256)


@query(_APPLIED)
def sign_diff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs from block signatures of old alone, applied to old."""
    both = text_pairs(spark, sf_dir)
    side = lambda name: both.select("stream_id", F.col(name).alias("content"))
    signed = sync.rolling_signatures(side("old"), B)
    made = sync.diff_by_signature(signed, side("new"), B)
    return _applied(made.join(both, "stream_id"))


# a block is held where old has it and, unless one of them ends there, the next block behind it
@query(
    f"""WITH {_PAIRS}, padded AS (SELECT stream_id, old_size, o || repeat('00', 511) AS o FROM pairs),
    pieces AS (SELECT stream_id, old_size, c * 1024 AS base, substr(o, 2048 * c + 1, 2558) AS piece FROM (SELECT *, unnest(range(0, (old_size + 1023) // 1024)) AS c FROM padded)),
    windows AS (SELECT stream_id, base + i AS pos, md5(substr(piece, 2 * i + 1, 512)) AS h FROM (SELECT *, unnest(range(0, least(1024, old_size - base))) AS i FROM pieces)),
    blocks AS (SELECT stream_id, k, md5(rpad(substr(n, 512 * k + 1, 512), 512, '0')) AS h FROM (SELECT stream_id, n, unnest(range(0, (new_size + 255) // 256)) AS k FROM pairs)),
    held AS (SELECT DISTINCT b.stream_id, b.k FROM blocks AS b JOIN windows AS w ON b.stream_id = w.stream_id AND b.h = w.h
        LEFT JOIN blocks AS c ON b.stream_id = c.stream_id AND c.k = b.k + 1 LEFT JOIN windows AS v ON b.stream_id = v.stream_id AND v.pos = w.pos + 256
        WHERE c.k IS NULL OR v.pos IS NULL OR c.h = v.h),
    counted AS (SELECT stream_id, count(*) AS n FROM held GROUP BY stream_id)
    SELECT p.stream_id, (new_size + 255) // 256 AS blocks, (new_size + 255) // 256 - coalesce(c.n, 0) AS need_blocks, TRUE AS ok
    FROM pairs AS p LEFT JOIN counted AS c ON p.stream_id = c.stream_id"""
)
def zsync_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import zsync

    both = text_pairs(spark, sf_dir)
    side = lambda name: both.select("stream_id", F.col(name).alias("content"))
    return zsync.synchronise(side("old"), side("new"), 256)


@query()
def covers_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covers in the containers that diffs make."""
    return pairs.covers_of(pairs.diff(text_pairs(spark, sf_dir), "steps", "zlib", "block"))


@query()
def chunked_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_covers_in_chunks(text_pairs(spark, sf_dir), "block", B, 4096, 512)


@query()
def format_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, diff_bytes, new_bytes, ratio) of every container with a compressor."""
    out = pairs.diffs(text_pairs(spark, sf_dir), ["sections", "steps", "lite", "bsdiff", "endsley", "vcdiff"]).select("kind", F.octet_length("diff").alias("d"), "new_size")
    found = out.groupBy("kind").agg(F.sum("d").cast("long").alias("diff_bytes"), F.sum("new_size").alias("new_bytes"))
    return found.withColumn("ratio", F.col("diff_bytes") / F.col("new_bytes"))


from . import catalog_parts  # noqa: E402, F401  registers the queries of single operators
