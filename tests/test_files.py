import pytest
from pyspark.sql import functions as F

from deltaweave.operators import covers, files
from deltaweave.plans import directory, sync
from deltaweave.sources import manifests


@pytest.mark.parametrize(
    ("rules", "path", "hit"),
    [
        ("*.txt", "a/b.txt", True), ("*.txt", "a/b.txt2", False), ("dir/", "x/dir/f", True), ("dir/", "x/dir", False), ("a*c", "a/c", False),
        ("a*c", "abc", True), ("x#y", "y", True), ("#:1", "#1", True), ("*:", "*", True), ("*:", "b", False), ("*", "anything/at/all", True), ("", "a", False),
    ],
)
def test_ignore(spark, rules, path, hit):
    assert spark.range(1).select(files.ignored(F.lit(path), rules)).first()[0] is hit


def test_ignore_refuses_double_star():
    with pytest.raises(ValueError):
        files.ignore_pattern("a**b")


def tree(root, content):
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


NEW = {"a/same.txt": b"same" * 99, "a/moved.txt": b"moved" * 500, "b.bin": b"0123456789" * 700 + b"tail", "empty": b"", "new.txt": b"nothing alike"}
OLD = {"a/same.txt": b"same" * 99, "old/moved.txt": b"moved" * 500, "copy/moved.txt": b"moved" * 500, "b.bin": b"0123456789" * 700, "empty": b"", "gone.txt": b"x"}


def frame(spark, content):
    return spark.createDataFrame(sorted(content.items()), "path string, content binary")


def test_manifest_round_trip(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, NEW)
    (root / "hollow").mkdir()
    found = manifests.scan_directory(spark, f"file://{root}")
    assert [r["path"] for r in found.select("path").collect()] == sorted([*NEW, "hollow/"])
    target = str(tmp_path / "manifest")
    manifests.save_manifest(found, target)
    loaded = manifests.load_manifest(spark, target)
    states = {r["path"]: r["state"] for r in manifests.verify_manifest(found, loaded).collect()}
    assert set(states) == set(NEW) and set(states.values()) == {"ok"}
    tree(root, {"b.bin": b"other", "more": b"1"})
    (root / "new.txt").unlink()
    states = {r["path"]: r["state"] for r in manifests.verify_manifest(manifests.scan_directory(spark, f"file://{root}"), loaded).collect()}
    assert (states["b.bin"], states["more"], states["new.txt"]) == ("changed", "extra", "missing")
    assert "a/same.txt" not in [r["path"] for r in manifests.scan_directory(spark, f"file://{root}", "a/").collect()]


def test_directory_round_trip(spark):
    new, old = frame(spark, NEW), frame(spark, OLD)
    same = {r["new_path"]: r["old_path"] for r in files.same_files(new, old).collect()}
    assert same == {"a/same.txt": "a/same.txt", "a/moved.txt": "copy/moved.txt"}
    changes = directory.dir_diff(new, old).cache()
    made = {r["path"]: r for r in directory.dir_patch(changes, old).collect()}
    assert {p: bytes(r["content"]) for p, r in made.items()} == NEW and all(r["ok"] for r in made.values())
    assert {r["path"] for r in directory.removed(new, old).collect()} == {"old/moved.txt", "copy/moved.txt", "gone.txt"}
    row = directory.summary(changes, new, old).first()
    assert (row["new_files"], row["old_files"], row["copies"], row["deltas"]) == (5, 6, 2, 3)


def test_directory_empty_sides(spark):
    none = frame(spark, {"x": b""}).where("false")
    assert directory.dir_diff(none, frame(spark, OLD)).count() == 0
    made = directory.dir_patch(directory.dir_diff(frame(spark, NEW), none), none).collect()
    assert {r["path"]: bytes(r["content"]) for r in made} == NEW


def test_split_output_and_layout(spark):
    sized = files.with_digest(frame(spark, NEW)).select("path", "size")
    layout = files.ref_stream_by_range(sized, "path", 16)
    assert sorted(layout.collect()) == sorted(files.ref_stream(sized, "path", 16).collect())
    whole = bytearray(max(r["end"] for r in layout.collect()))
    for r in layout.collect():
        whole[r["begin"] : r["end"]] = NEW[r["path"]]
    segments = spark.createDataFrame([(i, bytes(whole[i : i + 1000])) for i in range(0, len(whole), 1000)], "pos long, bytes binary")
    parts = {}
    for r in files.split_output(segments, layout).orderBy("path", "offset").collect():
        parts[r["path"]] = parts.get(r["path"], b"") + bytes(r["bytes"])
    assert parts == {p: c for p, c in NEW.items() if c}


def test_unpack_covers(spark):
    old_parts = spark.createDataFrame([("s", 100, 50), ("s", 300, 50)], "stream_id string, pos long, length long")
    new_parts = spark.createDataFrame([("s", 0, 30), ("s", 1000, 70)], "stream_id string, pos long, length long")
    packed = spark.createDataFrame([("s", 20, 10, 60)], "stream_id string, old_pos long, new_pos long, length long")
    got = sorted(tuple(r) for r in covers.unpack_covers(packed, old_parts, new_parts).collect())
    assert got == [("s", 120, 10, 20), ("s", 140, 1000, 10), ("s", 300, 1010, 30)]


def test_violations_are_found(spark):
    rows = [("s", 0, 0, 10), ("s", 5, 8, 5), ("s", 0, 20, 0), ("s", 95, 30, 10), ("s", 0, 90, 20)]
    sizes = spark.createDataFrame([("s", 100, 100)], "stream_id string, old_size long, new_size long")
    found = covers.violations(spark.createDataFrame(rows, "stream_id string, old_pos long, new_pos long, length long"), sizes)
    assert sorted(r["new_pos"] for r in found.collect()) == [8, 20, 30, 90]


def test_link_near_and_requests(spark):
    rows = spark.createDataFrame([("s", 0, 0, 10), ("s", 20, 20, 10), ("s", 900, 900, 5)], "stream_id string, old_pos long, new_pos long, length long")
    assert sorted(tuple(r) for r in covers.link_near(rows).collect()) == [("s", 0, 0, 30), ("s", 900, 900, 5)]
    ranges = spark.createDataFrame([("s", i * 10, i * 10 + 5, 1) for i in range(5)], "stream_id string, first_byte long, last_byte long, blocks long")
    assert [r["request"] for r in covers.request_batches(ranges, 2).orderBy("first_byte").collect()] == [0, 0, 1, 1, 2]


def test_sync_resumes_and_detects_damage(spark):
    content = lambda rows: spark.createDataFrame(rows, "stream_id long, content binary")
    old, new = content([(1, b"abcd" * 300), (2, b"")]), content([(1, b"abcd" * 200 + b"changed" * 40 + b"abcd" * 100), (2, b"fresh" * 60)])
    assert all(r["ok"] for r in sync.synchronise(old, new, 64).collect())
    signed, payload = sync.publish(new, 64)
    located = sync.positions(old, new, 64)
    needed = signed.select("stream_id", "block_index").subtract(located.where("old_pos IS NOT NULL").select("stream_id", "block_index"))
    got = sync.fetch(needed, signed, payload)
    first = got.where("block_index < 14")
    rest = sync.fetch(sync.resume(needed, first), signed, payload)
    assert all(r["ok"] for r in sync.rebuild(old, located, first.unionByName(rest), signed, 64).collect())
    damaged = got.withColumn("bytes", F.when(F.col("stream_id") == 2, F.lit(b"zz").cast("binary")).otherwise(F.col("bytes")))
    assert {r["stream_id"]: r["ok"] for r in sync.rebuild(old, located, damaged, signed, 64).collect()} == {1: True, 2: False}


def test_layout_of_a_million_files(spark):
    """Ranges are dealt once: no place is given twice and none is left out."""
    n = 1_000_000
    sized = spark.range(n).select(F.format_string("%s/%07d", F.md5(F.col("id").cast("string")), "id").alias("path"), (F.col("id") % 97 + 1).alias("size"))
    layout = files.ref_stream_by_range(sized, "path", 16)
    room = F.ceil(F.col("size") / 16) * 16
    row = layout.agg(F.countDistinct("begin").alias("begins"), F.max(F.col("begin") + room).alias("end"), F.sum(room).alias("rooms"), F.min("begin").alias("first")).first()
    assert (row["begins"], row["end"], row["first"]) == (n, row["rooms"], 0)


def test_numbers_and_index_codes(spark):
    paths = spark.createDataFrame([(p,) for p in ("b", "a", "d", "c")], "path string")
    assert sorted(tuple(r) for r in files.numbered(paths, "path").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    pairs_ = spark.createDataFrame([(2, 7), (5, 3), (6, 4)], "new_index long, old_index long")
    assert sorted(tuple(r) for r in files.same_pair_deltas(pairs_).collect()) == [(0, 2, 7), (1, 2, -5), (2, 0, 0)]
    listed = spark.createDataFrame([(0, 3), (1, 4), (2, 9)], "index long, place long")
    assert sorted(tuple(r) for r in files.index_deltas(listed, "place").collect()) == [(0, 3), (1, 0), (2, 4)]
    assert files.numbered(paths.where("false"), "path").count() == 0


def test_sync_diff_without_network(spark):
    content = lambda rows: spark.createDataFrame(rows, "stream_id long, content binary")
    old = content([(1, b"abcd" * 300), (2, b""), (3, b"q" * 640)])
    new = content([(1, b"abcd" * 200 + b"changed" * 40 + b"abcd" * 100), (2, b"fresh" * 60), (3, b"q" * 640 + b"r" * 640)])
    signed, _ = sync.publish(new, 64)
    codes, given = sync.local_diff(old, new, 64)
    made = sync.local_patch(old, codes, given, signed, 64)
    whole = {}
    for r in made.orderBy("stream_id", "block_index").collect():
        assert r["ok"]
        whole[r["stream_id"]] = whole.get(r["stream_id"], b"") + bytes(r["bytes"])
    assert whole == {r["stream_id"]: bytes(r["content"]) for r in new.collect()}
    assert given.where("stream_id = 3").count() == 1  # ten equal new blocks, sent once
    assert codes.where("stream_id = 2").select("kind").distinct().collect()[0]["kind"] == "miss"


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from deltaweave.operators import tables

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        tables.shared_folder(Session())
