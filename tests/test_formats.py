"""Round trips of every container, with the hand-written and the random cases."""

import random

import numpy as np
import pytest

from deltaweave.functions import codecs, formats, kernels

DIGITS = "123456789876543212345677654321234567765432"
LETTERS = "asadsdasfefw45fg4gacasc234fervsvdfdsfef4g4gr"
EDGES = [
    ("", ""), ("", "1"), ("1", ""), ("1", "1"), ("22", "11"), ("22", "22"), ("1234567890", "1234567890"), (DIGITS, LETTERS),
    (DIGITS + LETTERS, LETTERS), (LETTERS + DIGITS, LETTERS), ("a" + DIGITS + LETTERS, LETTERS), (DIGITS + LETTERS + "1", LETTERS),
    ("a" + DIGITS + LETTERS + "1", LETTERS),
]


def random_pair(seed):
    rnd = random.Random(seed)
    size = int(rnd.random() * rnd.random() * 8192)
    old = rnd.randbytes(size)
    new = bytearray(rnd.randbytes(int(size * (0.7 + rnd.random() * 0.8))))
    for _ in range(int(size**0.5)):
        n = int(rnd.random() * size / 4)
        if 0 < n < len(new):
            i, j = rnd.randrange(size - n + 1), rnd.randrange(len(new) - n + 1)
            new[j : j + n] = old[i : i + n]
    return bytes(new), old


CASES = [(a.encode(), b.encode()) for a, b in EDGES] + [random_pair(s) for s in range(30)]
FINDERS = {
    "none": lambda old, new: [],
    "block": lambda old, new: kernels.block_covers(old, new, 16),
    "longest": kernels.longest_covers,
    "selected": lambda old, new: kernels.select_covers(old, new, kernels.link_covers(kernels.extend_covers(old, new, kernels.longest_covers(old, new)))),
}


@pytest.mark.parametrize("finder", FINDERS)
@pytest.mark.parametrize("kind", formats.ENCODE)
def test_round_trip(kind, finder):
    for new, old in CASES:
        a, b = kernels.as_array(old), kernels.as_array(new)
        covers = FINDERS[finder](a, b)
        assert kernels.check_covers(covers, len(a), len(b))
        for packing in ("", "zlib", "bz2", "lzma") if kind in ("sections", "steps", "lite") else ("",):
            data = formats.encode(kind, a, b, covers, packing)
            made = formats.decode_plain(a, data, len(b)) if kind == "plain" else formats.decode(a, data)
            assert made == new


@pytest.mark.parametrize("kind", formats.DECODE)
def test_identical_data_is_smaller(kind):
    data = random.Random(1).randbytes(400) * 2
    a = kernels.as_array(data)
    assert len(formats.encode(kind, a, a, kernels.block_covers(a, a, 16))) < len(data)


@pytest.mark.parametrize("kind", formats.DECODE)
def test_damage_is_refused_or_bounded(kind):
    rnd = random.Random(3)
    for new, old in CASES[8:24]:
        a, b = kernels.as_array(old), kernels.as_array(new)
        data = formats.encode(kind, a, b, kernels.block_covers(a, b, 16))
        for _ in range(10):
            bad = bytearray(data)
            bad[rnd.randrange(len(bad))] ^= 1 << rnd.randrange(8)
            try:
                made = formats.decode(a, bytes(bad))
            except ValueError:
                continue
            assert isinstance(made, bytes)


def test_steps_in_place_resave_and_info():
    for new, old in CASES:
        a, b = kernels.as_array(old), kernels.as_array(new)
        covers = kernels.longest_covers(a, b)
        assert formats.decode(a, formats.encode_steps(a, b, covers, "", 64)) == new
        safe = kernels.in_place_covers(covers, 20)
        lite = formats.encode_lite(a, b, safe, "zlib", 20)
        assert bytes(formats.patch_in_place(bytearray(old), len(old), lite)) == new
        sections = formats.encode_sections(a, b, covers)
        again = formats.resave_sections(sections, "zlib")
        assert formats.decode(a, again) == new
        head = formats.info(again)
        assert (head.old_size, head.new_size, head.covers, head.compress) == (len(a), len(b), len(covers), "zlib")


def test_another_old_stream_is_refused():
    a = kernels.as_array(b"abcdefgh" * 9)
    data = formats.encode_steps(a, a, [(0, 0, len(a))])
    with pytest.raises(ValueError):
        formats.decode(a[1:], data)


def test_integers_runs_and_compressors():
    for value in (0, 1, 127, 128, 16383, 16384, 2**40, 2**63, 2**64 - 1):
        for bits in range(8):
            code = codecs.pack_varint(value, (1 << bits) - 1, bits)
            assert len(code) == codecs.varint_size(value, bits)
            assert codecs.Reader(code).tagged(bits) == ((1 << bits) - 1, value)
    with pytest.raises(ValueError):
        codecs.Reader(b"\xff" * 12).varint()
    rnd = np.random.default_rng(2)
    for n in (0, 1, 5, 400):
        data = rnd.choice(np.array([0, 0, 0, 255, 255, 7, 9], np.uint8), n)
        assert (codecs.unpack_runs(*codecs.pack_runs(data), n) == data).all()
        assert (codecs.unpack_zero_runs(codecs.pack_zero_runs(data), n) == data).all()
        for tag in [*codecs.COMPRESS, *codecs.ALIASES]:
            assert codecs.decompress(tag, codecs.compress(tag, data.tobytes()), n) == data.tobytes()
        block = codecs.compress_with_dictionary(data.tobytes(), b"abc" * 50)
        assert codecs.decompress_with_dictionary(block, b"abc" * 50, n) == data.tobytes()
    with pytest.raises(ValueError):
        codecs.decompress("zlib", b"nonsense", 4)


def test_cover_tools():
    covers = [(0, 0, 100), (100, 100, 50), (300, 180, 40)]
    assert kernels.cut_covers([(0, 0, 100)], 30) == [(0, 0, 25), (25, 25, 25), (50, 50, 25), (75, 75, 25)]
    assert kernels.link_covers([(0, 0, 10), (20, 20, 10), (0, 40, 5)]) == [(0, 0, 30), (0, 40, 5)]
    assert kernels.collate_covers([(0, 0, 100), (90, 90, 30), (500, 110, 40)]) == [(0, 0, 110), (500, 110, 40)]
    assert [sum(n for *_, n in s) for s in kernels.steps_of(covers, 100)] == [100, 90]
    assert all(sum(n for *_, n in s) <= 16 for s in kernels.steps_of(covers, 16))
    assert not kernels.check_covers([(0, 5, 5), (0, 8, 5)], 20, 20)
    assert kernels.suffix_order(kernels.as_array(b"banana")).tolist() == [5, 3, 1, 0, 4, 2]
