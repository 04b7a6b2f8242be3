import random

import pytest

from deltaweave.sources import zsync


def test_md4_vectors():
    # the test suite of RFC 1320
    known = {b"": "31d6cfe0d16ae931b73c59d7e0c089c0", b"a": "bde52cb31de33e46245e05fbdbd6fb24", b"abc": "a448017aaf21d8525fc10ae87aa6729d", b"message digest": "d9130a8164549fe818874806e1c7014b"}
    for data, digest in known.items():
        assert zsync.md4(data).hex() == digest


@pytest.mark.parametrize(("rolling_bytes", "strong_bytes", "sequence"), [(4, 16, 1), (2, 4, 2), (3, 5, 2)])
def test_control_file_round_trip(rolling_bytes, strong_bytes, sequence):
    rnd = random.Random(5)
    old = rnd.randbytes(5000)
    for new in (b"", b"x", old, old[:3000] + b"new part" * 9 + old[2500:], old[100:], rnd.randbytes(700)):
        control = zsync.read_control(zsync.make_control(new, 64, "name", rolling_bytes, strong_bytes, sequence))
        assert (control.length, control.block_size) == (len(new), 64)
        places = zsync.locate(control, old)
        fetched = {i: new[i * 64 : i * 64 + 64] for i, at in enumerate(places) if at < 0}
        assert zsync.rebuild(control, old, places, fetched) == new
        if new in (old, old[100:]):
            assert len(fetched) <= 1


def test_damage_is_refused():
    raw = zsync.make_control(b"some data" * 50, 64)
    for bad in (b"", raw[:-1], raw.replace(b"Blocksize: 64", b"Blocksize: 0"), raw.replace(b"Length", b"Width")):
        with pytest.raises(ValueError):
            zsync.read_control(bad)
    control = zsync.read_control(raw)
    with pytest.raises(ValueError):
        zsync.rebuild(control, b"", [-1] * 8, {i: b"no" for i in range(8)})


def test_blocks_of_many_streams_are_digested_together():
    import numpy as np

    rnd = random.Random(6)
    for size in (1, 55, 56, 64, 256):
        rows = np.frombuffer(rnd.randbytes(20 * size), np.uint8).reshape(20, size)
        assert [d.tobytes() for d in zsync.md4_rows(rows)] == [zsync.md4(r.tobytes()) for r in rows]
    olds = [b"", b"ab" * 900, rnd.randbytes(3000), b"\0" * 500]
    news = [b"x" * 70, b"ab" * 500 + b"tail", olds[2][7:], b"\0" * 130]
    raw = zsync.make_controls(news, 64)
    assert raw == [zsync.make_control(new, 64) for new in news]
    controls = [zsync.read_control(r) for r in raw]
    found = zsync.locate_each(controls, olds)
    assert found == [zsync.locate(c, o) for c, o in zip(controls, olds)]
    assert found[1] == [0] * 14 + [1736, -1] and found[0] == [-1, -1]


def test_many_blocks_take_little_time():
    import time

    rnd = random.Random(7)
    data = rnd.randbytes(1_000_000)
    begun = time.process_time()
    control = zsync.read_control(zsync.make_control(data, 256))
    assert zsync.locate(control, data) == list(range(0, len(data), 256))
    assert time.process_time() - begun < 1.5
