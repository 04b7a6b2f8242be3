"""Byte kernels where window hashes collide."""

import numpy as np

from deltaweave.functions import kernels


def test_block_covers_tries_every_colliding_block(monkeypatch):
    monkeypatch.setattr(kernels, "window_hashes", lambda data, size: np.zeros(max(len(data) - size + 1, 0), np.uint64))
    old = np.repeat(np.arange(100, dtype=np.uint8), 16)
    assert kernels.block_covers(old, np.full(16, 90, np.uint8), 16) == [(90 * 16, 0, 16)]
    new = np.r_[np.full(16, 90, np.uint8), np.full(16, 3, np.uint8)]
    assert kernels.block_covers(old, new, 16) == [(90 * 16, 0, 16), (3 * 16, 16, 16)]


def test_longest_matches_by_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        old, new = (rnd.integers(0, rnd.choice([2, 4, 200]), rnd.integers(0, 60)).astype(np.uint8) for _ in range(2))
        length, source = kernels.longest_matches(old, new)
        for j in range(len(new)):
            best = max((kernels.common_prefix(old[i:], new[j:]) for i in range(len(old))), default=0)
            assert length[j] == best
            assert kernels.same_bytes(old, int(source[j]), new, j, best)


def test_suffix_array_of_runs_and_texts():
    rnd = np.random.default_rng(5)
    for data in (b"", b"a", b"aaaaaaaa", b"banana", bytes(rnd.integers(0, 3, 200).astype(np.uint8))):
        assert kernels.suffix_order(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_longest_covers_are_quick_on_long_streams():
    import time

    rnd = np.random.default_rng(6)
    old = rnd.integers(97, 123, 200_000).astype(np.uint8)
    new = np.concatenate([old[:90_000], rnd.integers(97, 123, 500).astype(np.uint8), old[70_000:]])
    begun = time.process_time()
    covers = kernels.longest_covers(old, new)
    assert time.process_time() - begun < 20
    assert kernels.check_covers(covers, len(old), len(new)) and sum(n for *_, n in covers) >= len(new) - 600
    assert all(kernels.same_bytes(old, i, new, j, n) for i, j, n in covers)


def test_links_must_pay_and_extensions_keep_a_share():
    rnd = np.random.default_rng(8)
    old = rnd.integers(0, 256, 400).astype(np.uint8)
    new = old.copy()
    new[100:104] = 0  # a short gap on the diagonal pays, a long one of noise does not
    covers = [(0, 0, 100), (104, 104, 296)]
    assert kernels.link_covers(covers, old=old, new=new) == [(0, 0, 400)]
    new[100:300] = rnd.integers(0, 256, 200)
    covers = [(0, 0, 100), (300, 300, 100)]
    assert kernels.link_covers(covers) == [(0, 0, 400)] and kernels.link_covers(covers, old=old, new=new) == covers
    assert [kernels.extension_ratio(k) for k in (-9, 6, 99)] == [200 / 1024, 470 / 1024, 800 / 1024]
    new = old.copy()
    new[110:130:4] ^= 1  # three of four bytes equal: grown over
    new[200:] ^= 1
    assert kernels.extend_covers(old, new, [(50, 50, 60)]) == [(0, 0, 200)]


def test_selected_covers_off_the_diagonal():
    from deltaweave.operators import pairs

    # two covers with a gap of another size on either side: nothing to link, no error
    old = np.frombuffer(b"first part of the text, twelve" + b"0123456789" + b"second part of the text, as long", np.uint8)
    new = np.frombuffer(b"first part of the text, twelve" + b"#-#" + b"second part of the text, as long", np.uint8)
    assert kernels.link_covers([(0, 0, 30), (40, 33, 32)], old=old, new=new) == [(0, 0, 30), (40, 33, 32)]
    assert pairs.FINDERS["selected"](old, new) == [(0, 0, 30), (40, 33, 32)]


def test_longest_covers_look_up_few_places():
    import time

    rnd = np.random.default_rng(9)
    words = [rnd.integers(97, 123, k).astype(np.uint8) for k in rnd.integers(3, 9, 2000)]
    old = np.concatenate([words[k] for k in rnd.integers(0, len(words), 70_000)])
    new = np.concatenate([old[:9000], old[9040:]])
    begun = time.process_time()
    assert kernels.longest_covers(old, new) == [(0, 0, 9000), (9040, 9000, len(old) - 9040)]
    assert time.process_time() - begun < 1.5


def test_window_hashes_of_long_streams_and_windows(monkeypatch):
    monkeypatch.setattr(kernels, "PIECE", 256)
    kernels._powers.cache_clear()
    data = np.random.default_rng(3).integers(0, 2, 3000).astype(np.uint8)
    for size in (1, 5, 64, 130, 700):
        hashes, seen = kernels.window_hashes(data, size), {}
        for i, h in enumerate(hashes.tolist()):
            seen.setdefault(h, set()).add(data[i : i + size].tobytes())
        assert len(hashes) == len(data) - size + 1 and all(len(v) == 1 for v in seen.values())
        assert len(seen) == len({data[i : i + size].tobytes() for i in range(len(hashes))})
    kernels._powers.cache_clear()


def test_nearest_blocks_by_brute_force():
    rnd = np.random.default_rng(12)
    for size in (2, 8, 9):
        for _ in range(60):
            old, new = (np.repeat(rnd.integers(0, 3, rnd.integers(0, 40)).astype(np.uint8), size) for _ in range(2))
            a, b = ([v[i : i + size].tobytes() for i in range(0, len(v) - size + 1, size)] for v in (old, new))
            once = [(a.index(x) - b.index(x)) * size for x in set(a) & set(b) if a.count(x) == b.count(x) == 1]
            usual = min(once, key=lambda d: (-once.count(d), d), default=0)
            want = []
            for j, x in enumerate(b):
                places = [i * size for i, y in enumerate(a) if x == y]
                if places:
                    want.append((j * size, min(places, key=lambda i: (abs(i - j * size - usual), i))))
            assert list(zip(*(c.tolist() for c in kernels.nearest_blocks(old, new, size)), strict=True)) == want


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_nearest_matches_without_a_shuffle(spark, sf_dir):
    from deltaweave.plans import catalog

    assert _shuffles(catalog.QUERIES["nearest_block_matches"](spark, sf_dir)) == 0


def test_sequential_blocks_by_brute_force(spark, sf_dir):
    from deltaweave.plans import catalog

    rnd = np.random.default_rng(13)
    for size in (1, 4, 64):
        for _ in range(60):
            old, new = (np.repeat(rnd.integers(0, 3, rnd.integers(0, 30)).astype(np.uint8), size) for _ in range(2))
            a, b = ([v[i : i + size].tobytes() for i in range(0, len(v) - size + 1, size)] for v in (old, new))
            want = [(j, i[0]) for j in range(len(b) - 1) if (i := [k for k in range(len(a) - 1) if a[k : k + 2] == b[j : j + 2]])]
            assert list(zip(*(c.tolist() for c in kernels.sequential_blocks(old, new, size)), strict=True)) == want
    assert _shuffles(catalog.QUERIES["seq_match_blocks"](spark, sf_dir)) == 0


def test_covers_that_could_be_longer_are_counted(spark):
    from deltaweave.operators import pairs

    both = spark.createDataFrame([(1, b"abcdefgh--", b"xxabcdefgh"), (2, b"same", b"same")], "stream_id long, old binary, new binary")
    table = lambda rows: spark.createDataFrame(rows, "stream_id long, old_pos long, new_pos long, length long")
    found = {"short": table([(1, 0, 2, 3), (2, 0, 0, 4)]), "cut": table([(1, 0, 2, 3), (1, 3, 5, 5)]), "broken": table([(2, 0, 0, 4), (2, 0, 1, 3)])}
    got = {(r["finder"], r["stream_id"]): (bytes(r["made"]), r["growable"], r["wrong"]) for r in pairs.checked_rebuilds(both, found).collect()}
    assert got[("short", 1)] == (b"xxabcdefgh", 1, 0) and got[("cut", 1)] == (b"xxabcdefgh", 0, 0)
    assert got[("short", 2)] == (b"same", 0, 0) and got[("broken", 2)][2] == 1 and len(got) == 6
    assert kernels.collate_covers([(0, 0, 20), (50, 10, 12), (90, 12, 30)]) == [(0, 0, 12), (90, 12, 30)]


def test_chunks_end_where_whole_streams_do(spark):
    from deltaweave.operators import pairs

    # a later chunk takes another old place for repeated bytes, whose end leaves less than a block
    rnd = np.random.default_rng(21)
    rows = []
    for k in range(40):
        part = rnd.integers(97, 123, 130).astype(np.uint8)
        old = rnd.integers(97, 123, 900).astype(np.uint8)
        old[40 + k : 170 + k] = part
        old[580 + k : 710 + k] = part
        rows.append((k, old.tobytes(), b"INSERTED " + old[:800].tobytes()))
    both = spark.createDataFrame(rows, "stream_id long, old binary, new binary")
    made = pairs.checked_rebuilds(both, {"chunks": pairs.find_covers_in_chunks(both, "block", 64, 512, 128)}).collect()
    assert len(made) == 40 and all(r["growable"] == r["wrong"] == 0 for r in made)
    line = np.arange(50, dtype=np.uint8)
    assert kernels.grow_ends(line, line, [(0, 0, 10), (20, 20, 5)]) == [(0, 0, 50)]


def test_byte_operators_on_binaries(spark):
    from pyspark.sql import functions as F

    from deltaweave.functions import codecs
    from deltaweave.operators import bytes as byte_ops

    rows = [(1, b"aabbbc", b"aabbb"), (2, b"", b"xyz"), (3, None, b"x"), (4, b"\0\0\xff\xff\1", b"\1\1\1\1\1\1\1"), (5, b"a" * 70000, b"b" * 70000)]
    both = spark.createDataFrame(rows, "stream_id long, old binary, new binary")
    made = both.select("stream_id", byte_ops.subtract(F.col("new"), F.col("old")).alias("d"), byte_ops.add(byte_ops.subtract(F.col("new"), F.col("old")), F.col("old")).alias("n"))
    got = {r["stream_id"]: (bytes(r["d"]), bytes(r["n"])) for r in made.collect()}
    for k, old, new in rows:
        n = min(len(old or b""), len(new))
        assert got[k] == (bytes((y - x) % 256 for x, y in zip(old or b"", new)), new[:n])
    streams = both.select("stream_id", F.col("old").alias("content"))
    back = byte_ops.run_lists(streams).select("stream_id", byte_ops.expand_runs(F.col("values"), F.col("lengths")).alias("v"))
    assert {r["stream_id"]: bytes(r["v"]) for r in back.collect()} == {k: old or b"" for k, old, _ in rows}
    assert {tuple(r) for r in byte_ops.region_cost(streams).collect()} == {(1, 5), (4, 2), (5, 2)}
    assert {tuple(r) for r in byte_ops.zero_runs(streams).where("stream_id in (1, 4)").collect()} == {(1, 0, 0, 6), (4, 0, 2, 3)}
    sums = both.select("stream_id", byte_ops.byte_sums(F.col("old")).alias("s")).where("stream_id = 4").first()["s"]
    assert tuple(sums) == (5, 2, 255 * 3 + 255 * 4 + 5)
    assert [len(c) for c in codecs.zero_run_sizes(np.zeros(0, np.uint8))] == [0, 0]
