"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, byte_bpe, decontaminate, language_id, license_scan, line_dedup, pii, simhash_dedup, token_pack, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """The result of :func:`pii.find_pii` as counts, a digest and a span list."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(_span_list(F.col("base")), 256).alias("base_sha256"),
        _span_list(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(pii.find_pii(_table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language_id.identify(documents, language_id.learn_from(documents))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_of(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less the boilerplate of its source."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(documents, F.col("source"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; a page counts as bad where its label is toxic."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("bad"))
    return url_rules.judge(_table(spark, sf_dir, "pages"), labels)


def url_rules_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of op5 with labels that URLs explain, so that rules are mined."""
    pages, url = _table(spark, sf_dir, "pages"), F.col("url")
    has = lambda part: F.contains(url, F.lit(part))
    bad = has("/es/") | (has("//m.") & has("/en/"))
    return url_rules.judge(pages, pages.where("url is not null").select("page_id", bad.alias("bad")))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    vectors = ann_search.usable(_table(spark, sf_dir, "embeddings"))
    return ann_search.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def hit_digests(found: DataFrame) -> DataFrame:
    """The result of :func:`decontaminate.decontaminate` as counts and a digest."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return hit_digests(decontaminate.decontaminate(documents, benchmark))


def token_digests(encoded: DataFrame) -> DataFrame:
    """The ids and decoded bytes of :func:`byte_bpe.encode_decode` as digests."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_digests(byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_pack.pack(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packed rows of op8 hold of each document, and whether they keep
    to the length of a row."""
    packed = op8_token_packing(spark, sf_dir)
    parts = token_pack.segment_bytes(packed.where(F.col("n_tokens") <= token_pack.ROW_LENGTH), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("doc_offset", F.hex("bytes").alias("hex")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return listed.select("doc_id", F.sha2(whole, 256).alias("decoded_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_language_id,
        op3_license_scan,
        op4_line_dedup,
        op5_url_filter,
        url_rules_mined,
        op6_ann_search,
        op7_benchmark_decontamination,
        op8_token_packing,
        packed_texts,
        op9_byte_bpe,
        op10_simhash_near_dedup,
    )
}

_LICENSE_WORDS = f"string_split_regex(trim(regexp_replace(regexp_replace(lower(line), '{license_scan.NOT_WORDS}', ' ', 'g'), '{license_scan.FINAL_DOTS}', ' ', 'g')), ' +')"
_LICENSE_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_LEAST, _MOST = license_scan.THRESHOLD / (2 - license_scan.THRESHOLD), (2 - license_scan.THRESHOLD) / license_scan.THRESHOLD
_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_scan.TEMPLATES.items())
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EXPLICIT = sorted(url_rules.RULES, key=lambda r: -len(r[1] + r[2]))
_RULE_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".format(h + p) for _, h, p in _EXPLICIT)
_VERDICTS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in _EXPLICIT)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"



def _judged(label: str) -> str:
    """The SQL of a URL filter whose labels a query gives: every set of tokens of
    a page is tried as a rule."""
    return f"""
        WITH hosts AS (
            SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url,
                   {_LOWER.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), parsed AS (
            SELECT *, list_sort(list_distinct(
                list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x)
                || list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'path:' || lower(x))
                || list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query:' || split_part(x, '=', 1))
            )) AS tokens FROM hosts
        ), label AS ({label}), baskets AS (
            SELECT row, tokens, bad FROM parsed JOIN label USING (page_id) WHERE len(tokens) > 0 OR bad
        ), subsets AS (
            SELECT row, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS subset
            FROM (SELECT row, tokens, unnest(range(1, (1::BIGINT << len(tokens)))) AS mask FROM parsed)
        ), rules AS (
            SELECT subset FROM subsets JOIN baskets USING (row) GROUP BY subset
            HAVING count(*) FILTER (bad) >= (SELECT greatest(ceil({url_rules.MIN_SUPPORT} * count(*)), {url_rules.MIN_COUNT}) FROM baskets)
               AND count(*) FILTER (bad) / count(*) >= {url_rules.MIN_CONFIDENCE}
        ), hit AS (SELECT DISTINCT row FROM subsets JOIN rules USING (subset)),
        judged AS (SELECT row, page_id, host, path, CASE {_RULE_CASES} END AS rule FROM parsed)
        SELECT page_id, host, path, rule, CASE rule {_VERDICTS} ELSE CASE WHEN hit.row IS NULL THEN 'allow' ELSE 'block' END END AS verdict
        FROM judged LEFT JOIN hit ON judged.row = hit.row"""


ORACLE_SQL: dict[str, str] = {
    "packed_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "op3_license_scan": f"""
        WITH templates(template, line) AS (VALUES {_TEMPLATES}), template_words AS (
            SELECT template, {_LICENSE_WORDS} AS w FROM templates
        ), template_sets AS (SELECT template, list_distinct({_LICENSE_PAIRS}) AS t FROM template_words),
        template_pairs AS (SELECT template, len(t) AS size, unnest(t) AS pair FROM template_sets),
        segments AS (
            SELECT row, unnest(range(0, len(segments))) AS segment, unnest(segments) AS line FROM (
                SELECT row_number() OVER () AS row, string_split(regexp_replace(text, '{license_scan.SEGMENT_END}', '\\1' || chr(10), 'g'), chr(10)) AS segments FROM documents)
        ), words AS (
            SELECT row, segment, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT row, segment, {_LICENSE_WORDS} AS w FROM segments)
        ), numbered AS (SELECT row, segment, word, row_number() OVER (PARTITION BY row ORDER BY segment, i) AS k FROM words WHERE word <> ''),
        pairs AS (
            SELECT a.row, a.k, a.word || ' ' || b.word AS pair, a.segment AS a, b.segment AS b FROM numbered AS a JOIN numbered AS b ON a.row = b.row AND b.k = a.k + 1
        ), hits AS (SELECT row, k, template, size, pair, a, b FROM pairs JOIN template_pairs USING (pair)),
        enough AS (
            SELECT row, template, size FROM hits GROUP BY ALL HAVING count(DISTINCT pair) >= size * {_LEAST} - 1e-9
        ), bounds AS (SELECT row, segment, min(k) AS first_k, max(k) AS last_k FROM numbered GROUP BY ALL),
        units AS (
            SELECT u.row, u.template, u.size, u.unit, u.last, f.first_k, l.last_k - f.first_k AS n_pairs FROM (
                SELECT DISTINCT row, template, size, x.a AS unit, y.b AS last FROM enough JOIN hits AS x USING (row, template, size) JOIN hits AS y USING (row, template, size) WHERE y.b >= x.a
            ) AS u JOIN bounds AS f ON u.row = f.row AND u.unit = f.segment JOIN bounds AS l ON u.row = l.row AND u.last = l.segment
            WHERE l.last_k - f.first_k >= u.size * {_LEAST} - 1e-9 AND l.last_k - f.first_k <= u.size * {_MOST} + 1e-9
        ), shared AS (
            SELECT u.row, u.template, unit, last, count(DISTINCT h.pair) AS shared FROM units AS u JOIN hits AS h ON u.row = h.row AND u.template = h.template AND h.a >= unit AND h.b <= last GROUP BY ALL
        ), sizes AS (
            SELECT u.row, unit, last, count(DISTINCT pair) AS n FROM (SELECT DISTINCT row, unit, last, first_k, n_pairs FROM units) AS u
            JOIN pairs AS p ON u.row = p.row AND p.k >= first_k AND p.k < first_k + n_pairs GROUP BY ALL
        ), scored AS (
            SELECT u.row, u.unit, u.last, n_pairs, u.template, 2 * shared / (n + size) AS dice FROM units AS u
            JOIN shared AS s ON u.row = s.row AND u.template = s.template AND u.unit = s.unit AND u.last = s.last
            JOIN sizes AS z ON u.row = z.row AND u.unit = z.unit AND u.last = z.last
        ), best AS (
            SELECT *, row_number() OVER (ORDER BY dice DESC, n_pairs DESC, unit, last, template) AS place FROM (
                SELECT *, row_number() OVER (PARTITION BY row, unit, last ORDER BY dice DESC, template) AS nth FROM scored WHERE dice >= {license_scan.THRESHOLD}) WHERE nth = 1
        ), tops AS (SELECT row, segment, min(place) AS place FROM (SELECT row, place, unnest(range(unit, last + 1)) AS segment FROM best) GROUP BY ALL),
        won AS (SELECT b.* FROM best AS b JOIN (SELECT place, count(*) AS n FROM tops GROUP BY place) AS t ON b.place = t.place AND t.n = last - unit + 1)
        SELECT any_value(doc_id) AS doc_id, list_sort(list(DISTINCT template)) AS licenses, count(*) AS n_lines, max(dice)::DOUBLE AS best_dice
        FROM won JOIN (SELECT row_number() OVER () AS row, doc_id FROM documents) USING (row) GROUP BY row""",
    "op5_url_filter": _judged(
        """SELECT doc_id AS page_id, max(coalesce(toxic = 1, FALSE)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id"""
    ),
    "url_rules_mined": _judged(
        """SELECT page_id, max(contains(url, '/es/') OR contains(url, '//m.') AND contains(url, '/en/')) AS bad
            FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL GROUP BY page_id"""
    ),
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT row, source, text, unnest(list_distinct(list_filter(list_transform(
                       string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line
            FROM (SELECT row_number() OVER () AS row, source, text FROM documents)
        ), totals AS (
            SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source
        ), bad AS (
            SELECT l.source, list(line) AS lines FROM (
                SELECT source, line, count(*) AS pages FROM lines GROUP BY source, line
            ) AS l JOIN totals AS t ON l.source = t.source
            WHERE pages >= {line_dedup.MIN_PAGES}
              AND pages > CASE WHEN length(line) < {line_dedup.SHORT_CHARS} THEN {line_dedup.SHORT_RATIO} ELSE {line_dedup.RATIO} END * total
            GROUP BY l.source
        ), left_lines AS (
            SELECT doc_id, d.source, text, list_filter(string_split(text, chr(10)),
                       lambda x: trim(x) = '' OR NOT list_contains(lines, trim(x))) AS lines, bad.lines IS NULL AS same
            FROM documents AS d LEFT JOIN bad ON d.source = bad.source
        )
        SELECT doc_id, source,
               CASE WHEN same OR text IS NULL THEN text ELSE array_to_string(lines, chr(10)) END AS text,
               CASE WHEN same OR text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) - len(lines) END::BIGINT AS dropped_lines
        FROM left_lines""",
    "op7_benchmark_decontamination": f"""
        WITH doc AS (
            SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), lambda x: x <> '') AS words
            FROM documents
        ), item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words
            FROM benchmark
        ), item_windows AS (
            SELECT DISTINCT item_id, n, words[i : i + n - 1] AS window_words FROM (
                SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM (
                    SELECT *, least(10, len(words)) AS n FROM item WHERE len(words) > 0))
        ), doc_windows AS (
            SELECT row, i, n, words[i : i + n - 1] AS window_words FROM (
                SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i
                FROM doc, (SELECT DISTINCT n FROM item_windows))
        ), hits AS (
            SELECT row, i, d.n, item_id FROM doc_windows AS d JOIN item_windows AS w
            ON d.n = w.n AND d.window_words = w.window_words
        ), hit_words AS (
            SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS j FROM hits) GROUP BY row
        ), hit_items AS (
            SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY row
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)""",
}
