"""Byte kernels over one pair of streams, used inside Arrow-batched operators.

A cover is ``(old_pos, new_pos, length)``.  Everything works on NumPy arrays of
unsigned bytes and takes memory in proportion to the streams of one pair.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

from .codecs import varint_size

#: An odd base of window hashes, and a number for every byte value.
BASE = 0x9E3779B97F4A7C15
BYTE_NUMBERS = np.random.default_rng(0x5EED).integers(1, 1 << 64, 256, np.uint64)
#: Bytes that are hashed with one table of powers.
PIECE = 1 << 18
#: Equal bytes that an extension starts with.
SMOOTHING = 4
Cover = tuple[int, int, int]


def as_array(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint8)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64."""
    up, down = (np.full(PIECE, base, np.uint64) for base in (BASE, pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the window of ``size`` bytes at every offset.

    A window is a polynomial over numbers of its bytes, taken from running sums,
    so the cost does not depend on ``size`` while that is below ``PIECE``.
    """
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers()
    if size * 2 > PIECE:
        up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size * 2, p[1], np.uint64)]) for p in (up, down))
    out = np.empty(n, np.uint64)
    step = len(up) - size
    for at in range(0, n, step):
        part = data[at : at + step + size - 1]
        total = np.cumsum(BYTE_NUMBERS[part] * up[: len(part)], dtype=np.uint64)
        count = len(part) - size + 1
        found = total[size - 1 :].copy()
        found[1:] -= total[: count - 1]
        out[at : at + count] = found * down[:count]
    return out


def hash_hits(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, place): the offsets whose hash is in a sorted table, and where it is
    there first.  A bitmap of leading bits keeps most offsets out of the search."""
    seen = np.zeros(1 << 16, bool)
    seen[(table >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
    wanted = hashes[at]
    place = np.searchsorted(table, wanted, "left")
    hit = table[np.minimum(place, len(table) - 1)] == wanted
    return at[hit], place[hit]


def same_bytes(a: np.ndarray, i: int, b: np.ndarray, j: int, n: int) -> bool:
    return bool(np.array_equal(a[i : i + n], b[j : j + n]))


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Equal bytes at the start of both."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        stop = min(at + step, n)
        differ = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, step * 4
    return n


def common_suffix(a: np.ndarray, b: np.ndarray) -> int:
    return common_prefix(a[::-1], b[::-1])


def first_positions(hashes: np.ndarray, data: np.ndarray, wanted: np.ndarray, other: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The least offset in ``data`` of each wanted window of ``other``, or -1.

    Candidates come by hash and are confirmed byte by byte.
    """
    out = np.full(len(places), -1, np.int64)
    if not len(hashes) or not len(places):
        return out
    table, group = np.unique(wanted, return_inverse=True)
    at, place = hash_hits(hashes, table)
    first = np.full(len(table), -1, np.int64)
    first[place[::-1]] = at[::-1]
    tried = first[group]
    asked = np.flatnonzero(tried >= 0)
    for k in range(0, len(asked), 4096):
        part = asked[k : k + 4096]
        windows = np.arange(size)
        same = (data[tried[part][:, None] + windows] == other[places[part][:, None] + windows]).all(1)
        out[part[same]] = tried[part[same]]
        for i in part[~same]:  # other windows of this hash
            out[i] = next((o for o in at[place == group[i]] if same_bytes(data, o, other, places[i], size)), -1)
    return out


def sync_positions(old: np.ndarray, new: np.ndarray, size: int) -> np.ndarray:
    """For each whole block of ``new`` its first offset in ``old``, or -1."""
    places = np.arange(len(new) // size, dtype=np.int64) * size
    wanted = window_hashes(new, size)[places] if len(places) else np.zeros(0, np.uint64)
    return first_positions(window_hashes(old, size), old, wanted, new, places, size)


def block_numbers(old: np.ndarray, new: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every whole block of either stream; equal blocks have one."""
    sides = [data[: len(data) // size * size].reshape(-1, size) for data in (old, new)]
    rows = np.concatenate(sides)
    if size <= 8:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :size] = rows
        numbers = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True)[1]
    else:
        raw, known = rows.tobytes(), {}
        numbers = np.array([known.setdefault(raw[i : i + size], len(known)) for i in range(0, len(raw), size)], np.int64)
    return numbers[: len(sides[0])], numbers[len(sides[0]) :]


def sequential_blocks(old: np.ndarray, new: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block_index, old_index) of the whole blocks of ``new`` that equal an old one
    and whose next block equals the next old one; the least old block of several."""
    a, b = block_numbers(old, new, size)
    most = int(max(a.max(initial=0), b.max(initial=0))) + 1
    both, first = np.unique(a[:-1] * most + a[1:], return_index=True)
    wanted = b[:-1] * most + b[1:]
    if not len(both) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(both, wanted), len(both) - 1)
    at = np.flatnonzero(both[place] == wanted)
    return at, first[place[at]]


def usual_diagonal(a: np.ndarray, b: np.ndarray, size: int) -> int:
    """The most frequent old place less new place of blocks, by their numbers, that
    either side has once; the least on a tie, 0 if there are none."""
    (x, i, n), (y, j, m) = (np.unique(v, return_index=True, return_counts=True) for v in (a, b))
    _, p, q = np.intersect1d(x[n == 1], y[m == 1], assume_unique=True, return_indices=True)
    diagonals, counts = np.unique(i[n == 1][p] - j[m == 1][q], return_counts=True)
    return int(diagonals[np.argmax(counts)]) * size if len(diagonals) else 0


def nearest_blocks(old: np.ndarray, new: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(new_pos, old_pos): for each block of ``new`` the equal block of ``old`` that
    lies nearest to the usual diagonal, the lesser place on a tie.

    Old blocks are put in order by content and place, and each new block looks to
    the one before and behind it, so frequent blocks never become pairs.
    """
    a, b = block_numbers(old, new, size)
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(b), dtype=np.int64) * size
    wanted = at + usual_diagonal(a, b, size)
    order = np.argsort(a, kind="stable")
    ranked, places = a[order], order * size
    first, last = np.searchsorted(ranked, b, "left"), np.searchsorted(ranked, b, "right")
    room = len(old) + 2
    behind = np.searchsorted(ranked * room + places + 1, b * room + np.clip(wanted + 1, 0, room - 1), "right")
    has_before, has_after = behind > first, behind < last
    before, after = places[np.maximum(behind - 1, 0)], places[np.minimum(behind, len(places) - 1)]
    nearer = np.where(has_before & (~has_after | (wanted - before <= after - wanted)), before, after)
    some = has_before | has_after
    return at[some], nearer[some]


def block_covers(old: np.ndarray, new: np.ndarray, size: int, least: int = 16) -> list[Cover]:
    """Covers from aligned blocks of ``old`` met at any offset of ``new``.

    At the first offset that meets a block the match grows both ways; the scan
    goes on behind it.  The block that continues the last diagonal is preferred.
    """
    starts = np.arange(len(old) // size, dtype=np.int64) * size
    hashes = window_hashes(new, size)
    if not len(starts) or not len(hashes):
        return []
    table = window_hashes(old, size)[starts]
    order = np.argsort(table, kind="stable")
    ranked = table[order]
    candidates, low = hash_hits(hashes, ranked)
    high = np.searchsorted(ranked, hashes[candidates], "right")
    covers, end, diagonal = [], 0, None
    at = 0
    while at < len(candidates):
        j = int(candidates[at])
        options = starts[order[low[at] : high[at]]]
        if diagonal is not None and len(options) > 1:
            options = options[np.argsort(np.abs(options - j - diagonal), kind="stable")]
        i = next((int(o) for o in options if same_bytes(old, o, new, j, size)), None)
        if i is None:
            at += 1
            continue
        back = common_suffix(old[:i], new[end:j])
        ahead = common_prefix(old[i + size :], new[j + size :])
        length = back + size + ahead
        if length >= least:
            covers.append((i - back, j - back, length))
            end, diagonal = j + size + ahead, i - j
            at = int(np.searchsorted(candidates, end))
        else:
            at += 1
    return covers


def signature_covers(indexes: list[int], keys: np.ndarray, strong: list[str], old_size: int, new: np.ndarray, size: int, least: int = 16) -> list[Cover]:
    """Covers of ``new`` from nothing but the block signatures of old.

    ``keys`` are rolling sums as one number and ``strong`` MD5 digests of whole
    blocks.  The block that follows the last match is tried first, then the
    least one; touching covers become one.
    """
    from .checksums import rolling, rule_table

    a, s = rolling(new, size, 32, rule_table())
    sums = a | s << np.uint64(32)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    low, high = np.searchsorted(ranked, sums, "left"), np.searchsorted(ranked, sums, "right")
    covers: list[Cover] = []
    at, hits = 0, np.flatnonzero(high > low)
    while at < len(hits):
        j = int(hits[at])
        digest = hashlib.md5(new[j : j + size].tobytes()).hexdigest()
        options = [int(o) for o in order[low[j] : high[j]] if strong[o] == digest]
        if not options:
            at += 1
            continue
        wanted = covers[-1][0] + covers[-1][2] if covers and covers[-1][1] + covers[-1][2] == j else -1
        i = min(indexes[o] for o in options) * size
        if any(indexes[o] * size == wanted for o in options):
            i, (a0, b0, n0) = wanted, covers.pop()
            covers.append((a0, b0, n0 + size))
        else:
            covers.append((i, j, size))
        at = int(np.searchsorted(hits, j + size))
    return [c for c in covers if c[2] >= least and c[0] + c[2] <= old_size]


#: Symbols of nine bits that one number holds.
SYMBOLS = 7
_STEPS = np.array([1 << (9 * k) for k in range(SYMBOLS)], np.int64)


def _symbol_keys(data: np.ndarray, end: int) -> np.ndarray:
    """The first ``SYMBOLS`` symbols of every suffix as one number: a byte plus
    one, and ``end`` behind the last byte."""
    n = len(data)
    wide = np.full(n + SYMBOLS, end, np.int64)
    wide[:n] = data
    wide[:n] += 1
    two = wide[:-1] << 9 | wide[1:]
    four = two[:-2] << 18 | two[2:]
    return four[:n] << 27 | two[4 : 4 + n] << 9 | wide[6 : 6 + n]


def _sorted_suffixes(data: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys): the suffix array with an ``end`` of 0, less than all bytes, or
    257, more than all, and the sorted keys.

    Only suffixes whose beginnings are still equal are sorted on, by the ranks
    of what follows, and beginnings double.
    """
    n, key = len(data), _symbol_keys(data, end)
    order = np.argsort(key, kind="stable")
    keys = key[order]
    heads = np.r_[True, keys[1:] != keys[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = n if end else -1
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    left = np.flatnonzero(~(heads & np.r_[heads[1:], True]))
    width = SYMBOLS
    while len(left):
        own = order[left]
        both = rank[own] * (n + 2) + rank[own + width] + 1
        by = np.argsort(both, kind="stable")
        own, both = own[by], both[by]
        order[left] = own
        heads = np.r_[True, both[1:] != both[:-1]]
        rank[own] = left[np.maximum.accumulate(np.where(heads, np.arange(len(left)), 0))]
        left = left[~(heads & np.r_[heads[1:], True])]
        width *= 2
    return order, keys


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array."""
    return _sorted_suffixes(data, 0)[0] if len(data) else np.zeros(0, np.int64)


def _equal_from(a: bytes, i: int, b: bytes, j: int) -> int:
    """Equal bytes of two streams from two places on."""
    n, step = 0, 32
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        size = min(len(x), len(y))
        if x[:size] != y[:size]:
            differ = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return n + size - (differ.bit_length() + 7) // 8
        n += size
        if size < step:
            return n
        step *= 4
        if n >= 1024:
            return n + common_prefix(np.frombuffer(a, np.uint8)[i + n :], np.frombuffer(b, np.uint8)[j + n :])


class Suffixes:
    """The suffixes of an old stream in order, to look matches up in.

    The end of old comes behind all bytes and that of new before them.  The
    longest match of a new suffix is with one of its two neighbours, the one
    before it on a tie.
    """

    def __init__(self, old: np.ndarray) -> None:
        self.old = old.tobytes()
        self.order, self.keys = _sorted_suffixes(old, 257) if len(old) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def short(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(length, old_pos, low, high) by the first symbols alone; a place with
        low < high matches all of them, with the old suffixes low to high."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        length, source = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for near in (low - 1, low):
            some = (near >= 0) & (near < len(self.order))
            near = np.where(some, near, 0)
            other = self.keys[near] ^ keys
            found = np.where(some, SYMBOLS - np.searchsorted(_STEPS, other, "right"), 0)
            better = found > length
            length[better], source[better] = found[better], self.order[near[better]]
        return length, source, low, high

    def deep(self, new: bytes, j: int, low: int, high: int) -> tuple[int, int]:
        """(length, old_pos) of the longest match of ``new`` at ``j`` with the
        suffixes ``low`` to ``high``, which begin alike."""
        old, order = self.old, self.order
        before = after = SYMBOLS
        best_before = best_after = -1
        while low < high:
            middle = (low + high) // 2
            i = int(order[middle])
            known = min(before, after)
            n = known + _equal_from(old, i + known, new, j + known)
            if i + n < len(old) and j + n < len(new) and old[i + n] < new[j + n]:
                low, before, best_before = middle + 1, n, i
            else:
                high, after, best_after = middle, n, i
        if best_after < 0 or (best_before >= 0 and before >= after):
            return before, best_before
        return after, best_after


def longest_matches(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, old_pos) of the longest match in ``old`` at every place of ``new``."""
    if not len(old) or not len(new):
        return np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
    index = Suffixes(old)
    length, source, low, high = index.short(_symbol_keys(new, 0))
    data = new.tobytes()
    for j in np.flatnonzero(low < high):
        length[j], source[j] = index.deep(data, int(j), int(low[j]), int(high[j]))
    return length, source


_GROUPS = np.array([1 << (7 * k) for k in range(1, 9)], np.int64)


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of variable-length integers."""
    return 1 + np.searchsorted(_GROUPS, values, "right")


def longest_covers(old: np.ndarray, new: np.ndarray, least: int = 5, score: int = 2, index: Suffixes | None = None) -> list[Cover]:
    """Greedy longest matches of ``new`` in ``old`` by suffix array.

    A match counts if it is ``least`` bytes or more and saves ``score`` bytes
    over the cost of its control code.  Places are tried in order, many at a time,
    and only those between covers are looked up; ``index`` is that of ``old``.
    """
    covers: list[Cover] = []
    if not len(old) or not len(new):
        return covers
    index = index or Suffixes(old)
    keys, data = _symbol_keys(new, 0), new.tobytes()
    at, end, last_old, part = 0, 0, 0, 64
    begin = stop = 0
    room = 256
    while at < len(new):
        if at >= stop:  # look more places up, many where covers are short
            room = min(2 * room, 1 << 14) if at < stop + room else 256
            begin, stop = at, min(at + room, len(new))
            length, source, low, high = index.short(keys[begin:stop])
            deep = low < high
        part = min(part, stop - at)
        here = slice(at - begin, at - begin + part)
        n, i, tried = length[here], source[here], np.arange(at, at + part)
        cost = _sizes(2 * np.abs(i - last_old)) + _sizes(n) + _sizes(tried - end)
        found = None
        for k in np.flatnonzero(deep[here] | ((n >= least) & (n - cost >= score))).tolist():
            j, most, old_pos = at + k, int(n[k]), int(i[k])
            if deep[j - begin]:
                most, old_pos = index.deep(data, j, int(low[j - begin]), int(high[j - begin]))
                if most < least or most - varint_size(2 * abs(old_pos - last_old)) - varint_size(most) - varint_size(j - end) < score:
                    continue
            found = j, most, old_pos
            break
        if found is None:
            at, part = at + part, min(2 * part, 1 << 14)
            continue
        j, most, old_pos = found
        back = common_suffix(old[:old_pos], new[end:j])
        covers.append((old_pos - back, j - back, most + back))
        end, last_old, part = j + most, old_pos + most, 64
        at = end
    return covers


def extension_ratio(score: int = 6) -> float:
    """The share of equal bytes that an extension needs, by a match score.

    Fixed values: 36 for each point and 254, from 200 to 800, of 1024.
    """
    return min(max(36 * score + 254, 200), 800) / 1024


def extend_covers(old: np.ndarray, new: np.ndarray, covers: list[Cover], score: int = 6) -> list[Cover]:
    """Covers grown both ways over unequal bytes while enough bytes are equal.

    A side grows while the share of equal bytes, smoothed by ``SMOOTHING`` equal
    ones, stays above :func:`extension_ratio`, and back to the place where equal
    bytes less that share of all bytes peaks, within the gap to the neighbour.
    """
    ratio = extension_ratio(score)
    out: list[Cover] = []
    for k, (i, j, n) in enumerate(covers):
        floor = out[-1][1] + out[-1][2] if out else 0
        room = min(i, j - floor)
        if room > 0:
            back = _peak(old[i - room : i][::-1] == new[j - room : j][::-1], ratio)
            i, j, n = i - back, j - back, n + back
        ceiling = covers[k + 1][1] if k + 1 < len(covers) else len(new)
        room = min(len(old) - i - n, ceiling - j - n)
        if room > 0:
            n += _peak(old[i + n : i + n + room] == new[j + n : j + n + room], ratio)
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def _peak(equal: np.ndarray, ratio: float) -> int:
    at, gained, best, length = 0, 0.0, 0.0, 0
    while at < len(equal):
        gain = gained + np.cumsum(equal[at : at + 4096] - ratio)
        low = np.flatnonzero(gain + SMOOTHING * (1 - ratio) < 0)
        if len(low):
            gain = gain[: low[0]]
        if len(gain) and gain.max() > best:
            best, length = float(gain.max()), at + int(np.argmax(gain)) + 1
        if len(low):
            break
        at, gained = at + 4096, float(gain[-1])
    return length


def _control_size(cover: Cover, last: Cover) -> int:
    """Bytes of the control code of a cover behind another one."""
    (i, j, n), (a, b, m) = cover, last
    return varint_size(2 * abs(i - a - m)) + varint_size(n) + varint_size(max(0, j - b - m))


def link_covers(covers: list[Cover], most: int = 511, old: np.ndarray | None = None, new: np.ndarray | None = None) -> list[Cover]:
    """Covers on one diagonal with a gap of ``most`` bytes or less become one.

    With both streams the gap must also pay: the runs of its difference may cost
    no more than the control code of another cover.
    """
    out: list[Cover] = []
    for i, j, n in covers:
        if out:
            a, b, m = out[-1]
            gap = j - b - m
            near = a + j == i + b and 0 <= gap <= most
            if near and (old is None or new is None or gap < 1 or region_rle_cost(new[b + m : j] - old[a + m : i]) <= _control_size((i, j, n), out[-1])):
                out[-1] = (a, b, j + n - b)
                continue
        out.append((i, j, n))
    return out


def collate_covers(covers: list[Cover], least: int = 5) -> list[Cover]:
    """Covers found apart made ordered and free of overlap in ``new``.

    On an overlap a collinear cover extends the last one; another one cuts the
    last one short, which goes if less than ``least`` is left of it.  What that
    one had cut is then given back up to the next cover.
    """
    out: list[Cover] = []
    whole: list[int] = []
    for i, j, n in sorted(covers, key=lambda c: (c[1], -c[2], c[0])):
        if out:
            a, b, m = out[-1]
            if j < b + m:
                if a + j == i + b:
                    whole[-1] = max(m, j + n - b)
                    out[-1] = (a, b, whole[-1])
                    continue
                if j + n <= b + m:
                    continue
                if j - b < least:
                    out.pop()
                    whole.pop()
                    if out:
                        out[-1] = (*out[-1][:2], min(whole[-1], j - out[-1][1]))
                else:
                    out[-1] = (a, b, j - b)
            elif j == b + m and i == a + m:
                whole[-1] = m + n
                out[-1] = (a, b, m + n)
                continue
        out.append((i, j, n))
        whole.append(n)
    return out


def grow_ends(old: np.ndarray, new: np.ndarray, covers: list[Cover]) -> list[Cover]:
    """Covers grown at their end over equal bytes, up to the next one."""
    out: list[Cover] = []
    for k, (i, j, n) in enumerate(covers):
        stop = covers[k + 1][1] if k + 1 < len(covers) else len(new)
        n += common_prefix(old[i + n :], new[j + n : stop])
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out[-1][2] + n
            out.pop()
        out.append((i, j, n))
    return out


def region_rle_cost(difference: np.ndarray) -> int:
    """Bytes that the runs of a difference cost: leading zeros none, runs of 0
    or 255 one, another single byte one, other runs two."""
    rest = difference[int(np.argmax(difference != 0)) :] if (difference != 0).any() else difference[:0]
    if not len(rest):
        return 0
    cut = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    size, value = np.diff(np.r_[cut, len(rest)]), rest[cut]
    return int(np.where((value == 0) | (value == 255) | (size == 1), 1, 2).sum())


def select_covers(old: np.ndarray, new: np.ndarray, covers: list[Cover], least: int = 6) -> list[Cover]:
    """Covers that save ``least`` bytes over literals by the run cost of their
    difference and the size of their control code, or continue a diagonal."""
    out: list[Cover] = []
    for i, j, n in covers:
        last = out[-1] if out else (0, 0, 0)
        linked = bool(out) and last[0] + j == i + last[1]
        difference = new[j : j + n] - old[i : i + n]
        control = _control_size((i, j, n), last)
        if linked or n - region_rle_cost(difference) - control >= least:
            out.append((i, j, n))
    return out


def cut_covers(covers: list[Cover], most: int) -> list[Cover]:
    """Covers longer than ``most`` in halves until none is."""
    out: list[Cover] = []
    stack = list(reversed(covers))
    while stack:
        i, j, n = stack.pop()
        if n <= most:
            out.append((i, j, n))
        else:
            half = n // 2
            stack += [(i + half, j + half, n - half), (i, j, half)]
    return out


def steps_of(covers: list[Cover], budget: int) -> list[list[Cover]]:
    """Covers packed in order into steps whose cover bytes stay in ``budget``.

    A cover that alone is over it is cut to three quarters until it fits.
    """
    steps: list[list[Cover]] = [[]]
    used = 0
    for i, j, n in covers:
        while n:
            part = n
            while part > budget:
                part = max(1, part * 3 // 4)
            if used + part > budget and steps[-1]:
                steps.append([])
                used = 0
            steps[-1].append((i, j, part))
            used += part
            i, j, n = i + part, j + part, n - part
    return steps


def in_place_covers(covers: list[Cover], extra: int) -> list[Cover]:
    """Covers that can be patched in place with ``extra`` bytes kept aside: no
    cover reads old bytes that were overwritten."""
    return [c for c in covers if c[0] + extra >= c[1]]


def check_covers(covers: list[Cover], old_size: int, new_size: int) -> bool:
    """Positive lengths, in bounds, ordered and free of overlap in ``new``."""
    end = 0
    for i, j, n in covers:
        if n <= 0 or i < 0 or j < end or i + n > old_size or j + n > new_size:
            return False
        end = j + n
    return True


def literals(new: np.ndarray, covers: list[Cover]) -> list[bytes]:
    """The bytes before each cover and behind the last one."""
    out, end = [], 0
    for _, j, n in covers:
        out.append(new[end:j].tobytes())
        end = j + n
    return [*out, new[end:].tobytes()]


def apply_covers(old: np.ndarray, new_size: int, covers: list[Cover], parts: list[bytes], differences: list[bytes] | None = None) -> bytes:
    """New bytes from covers, literal parts and, if given, byte differences."""
    if not check_covers(covers, len(old), new_size) or len(parts) != len(covers) + 1:
        raise ValueError("covers are not in order or out of bounds")
    out = []
    for k, (i, _, n) in enumerate(covers):
        piece = old[i : i + n]
        if differences is not None:
            if len(differences[k]) != n:
                raise ValueError("a difference has not the size of its cover")
            piece = piece + as_array(differences[k])
        out += [parts[k], piece.tobytes()]
    out.append(parts[-1])
    made = b"".join(out)
    if len(made) != new_size:
        raise ValueError("the literal bytes have not the size that covers leave")
    return made
