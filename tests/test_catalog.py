"""Every registered query against its SQL, or against the round-trip law."""

import pytest

from deltaweave.plans import catalog

ROUND_TRIPS = [n for n in catalog.QUERIES if n.endswith("_roundtrip")]
COVERS = ["longest_match_covers", "selected_covers", "extended_block_covers", "block_then_longest_covers", "chunked_covers"]


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_same_as_sql(name, spark, sf_dir, same_rows):
    same_rows(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trip(name, spark, sf_dir):
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 200 and all(r["ok"] for r in rows)


@pytest.mark.parametrize("name", COVERS)
def test_covers_are_valid_and_rebuild(name, spark, sf_dir):
    from deltaweave.operators import covers, pairs

    both = catalog.text_pairs(spark, sf_dir)
    found = catalog.QUERIES[name](spark, sf_dir).cache()
    assert covers.violations(found, catalog.pair_sizes(both)).count() == 0
    if name != "selected_covers":  # those may differ in bytes
        made = pairs.rebuild(both, found).join(both, "stream_id")
        assert made.where("made <> new").count() == 0
        assert made.count() == 200


def test_covers_come_back_from_containers(spark, sf_dir):
    from deltaweave.operators import pairs

    want = sorted(map(tuple, catalog.extended_block_covers(spark, sf_dir).collect()))
    assert sorted(map(tuple, catalog.covers_read_back(spark, sf_dir).collect())) == want
    for kind in ("sections", "lite"):
        made = pairs.covers_of(pairs.diff(catalog.text_pairs(spark, sf_dir), kind, "zlib", "block"))
        assert sorted(map(tuple, made.collect())) == want


def test_formats_save_space(spark, sf_dir):
    assert all(0 < r["ratio"] < 0.3 for r in catalog.format_ratio(spark, sf_dir).collect())


def test_steps_hold_all_bytes(spark, sf_dir):
    steps = catalog.step_packing(spark, sf_dir).groupBy("stream_id").sum("cover_bytes", "literal_bytes").collect()
    sizes = {r["stream_id"]: r["new_size"] for r in catalog.pair_sizes(catalog.text_pairs(spark, sf_dir)).collect()}
    assert all(r[1] + r[2] == sizes[r[0]] for r in steps)


def test_window_sums_by_brute_force(spark):
    import numpy as np

    from deltaweave.functions.checksums import adler, rule_table
    from deltaweave.operators.bytes import window_sums

    data = bytes(range(200))
    row = window_sums(spark.createDataFrame([(1, data), (2, b"short"), (3, None)], "stream_id long, content binary"), 64).collect()
    sums = [adler(np.frombuffer(data[i : i + 64], np.uint8), 1 << 32, rule_table()) for i in range(137)]
    values = [a | (s & 0x7FFFFFFF) << 32 for a, s in sums]
    check = 0
    for v in values:
        check ^= v
    assert [tuple(r) for r in row] == [(1, 137, min(values), max(values), check)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).where("NOT ok").count() == 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_sentinels_match_once(spark, sf_dir):
    assert _nodes(catalog.cover_sentinels(spark, sf_dir), "MapInArrow") == 1


def test_containers_share_a_matching_and_round_trips_no_shuffle(spark, sf_dir):
    from deltaweave.plans import catalog_parts

    for query in (catalog_parts.container_kinds, catalog_parts.container_heads, catalog.format_ratio):
        assert _nodes(query(spark, sf_dir), "MapInArrow") == 1
    for name in ("plain", "sections", "steps", "lite", "bsdiff", "endsley", "vcdiff", "resaved"):
        assert _nodes(catalog.QUERIES[f"{name}_roundtrip"](spark, sf_dir), "Exchange ") == 0


def test_signature_diffs_of_odd_streams(spark):
    from deltaweave.operators import pairs
    from deltaweave.plans import sync

    rows = [(1, b"", b"new"), (2, b"old" * 50, b""), (3, b"abcdefgh" * 40, b"--" + b"abcdefgh" * 30), (4, b"short", b"short")]
    both = spark.createDataFrame(rows, "stream_id long, old binary, new binary")
    old, new = (both.selectExpr("stream_id", f"{c} AS content") for c in ("old", "new"))
    made = sync.diff_by_signature(sync.rolling_signatures(old, 16), new, 16)
    back = pairs.patch(made.join(both, "stream_id").select("stream_id", "old", "diff", "new_size"))
    assert {r["stream_id"]: bytes(r["made"]) for r in back.collect()} == {k: n for k, _, n in rows}
    assert {r["stream_id"]: len(r["diff"]) for r in made.collect()}[3] < 100


def test_sync_and_directories_read_what_was_written(spark, sf_dir):
    for name in ("sync_roundtrip", "dir_diff_roundtrip", "sync_diff_applied"):
        assert _nodes(catalog.QUERIES[name](spark, sf_dir), "MapInArrow") == 0
