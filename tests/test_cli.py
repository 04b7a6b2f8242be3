import pytest

from deltaweave.__main__ import main
from deltaweave.options import DiffOptions, block_size_for, parse_size


@pytest.mark.parametrize("kind", ["steps", "sections", "lite", "bsdiff", "endsley", "vcdiff"])
def test_file_round_trip(tmp_path, kind, capsys):
    old, new, diff, out = (tmp_path / n for n in ("old", "new", "diff", "out"))
    old.write_bytes(b"some old content " * 300)
    new.write_bytes(b"some old content " * 200 + b"and more" + b"some old content " * 100)
    assert main(["diff", str(old), str(new), str(diff), "--kind", kind]) == 0
    assert diff.stat().st_size < new.stat().st_size / 4
    assert main(["patch", str(old), str(diff), str(out)]) == 0 and out.read_bytes() == new.read_bytes()
    assert main(["test", str(old), str(new), str(diff)]) == 0
    assert main(["test", str(old), str(old), str(diff)]) == 1
    assert main(["diff", str(old), str(old), str(diff), "--refuse-equal"]) == 2
    if kind in ("steps", "sections", "lite"):
        assert main(["info", str(diff)]) == 0 and kind in capsys.readouterr().out


def test_directory_round_trip(spark, tmp_path):
    old, new, diff, out = (tmp_path / n for n in ("old", "new", "diff", "out"))
    for root, files in ((old, {"a": b"x" * 900, "d/b": b"same", "c": b""}), (new, {"a": b"x" * 900 + b"y", "d/moved": b"same", "c": b""})):
        for name, data in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(data)
    assert main(["dirdiff", str(old), str(new), str(diff)]) == 0
    assert main(["dirpatch", str(old), str(diff), str(out)]) == 0
    assert {p.relative_to(out).as_posix(): p.read_bytes() for p in out.rglob("*") if p.is_file()} == {"a": b"x" * 900 + b"y", "d/moved": b"same", "c": b""}
    assert main(["manifest", str(new), str(tmp_path / "m")]) == 0
    assert main(["verify", str(out), str(tmp_path / "m")]) == 0
    (out / "a").write_bytes(b"")
    assert main(["verify", str(out), str(tmp_path / "m")]) == 1


def test_options():
    assert [parse_size(t) for t in ("12", "2k", "3M", "1g")] == [12, 2048, 3 << 20, 1 << 30]
    assert block_size_for(1 << 20, 64) == 64 and block_size_for(100, 64) == 64 and block_size_for(100, 2) == 4
    for bad in ({"kind": "none"}, {"packing": "none"}, {"finder": "none"}, {"block_size": 1}):
        with pytest.raises(ValueError):
            DiffOptions(**bad)
    with pytest.raises(ValueError):
        parse_size("x")
