"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

The vocabulary is a file of ``base64(token) rank`` lines; its bytes (a file of
fixed size) are broadcast, so executors need no copy.  Each task cuts its
texts into pieces by the pattern, and sends every distinct unknown piece
through one recursive query: rows (piece, position, token, next token) join the
merge table, the leftmost pair of the least rank of each piece is contracted,
and a piece leaves the recursion at its fixpoint.  Ordered aggregation then
gives its ids, and a join of the ids with the vocabulary its decoded bytes.  A
text is the concatenation of its pieces, so a word that a task has met before
costs a look-up.  No shuffle takes place.

Texts are cut at single spaces between non-space characters before the pattern
is applied; no match of the pattern reaches over the start of such a space.

A long piece (text without spaces) is contracted in overlapping parts.  A
sequence of tokens is the encoding of its bytes if each two neighbours are the
encoding of theirs, so two parts that share a token are joined at it exactly;
two that share none become one longer part and are contracted again.  A query
takes parts of bounded total work and spills nothing.

Defined cases: a null text is an empty one, with no ids and empty decoded
bytes; bytes that are no UTF-8 are read as U+FFFD; texts of any length are
encoded whole; repeated rows stay repeated;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import TEXT_ROWS, leaving_nothing, slices, small_batches

#: Characters of text that are encoded at a time; pieces in one recursive query,
#: and its rows, at most half the squares of their bytes.
BATCH_CHARS, BLOCK_PIECES, BLOCK_SQUARES = 3 << 20, 1 << 14, 1 << 22
#: Pieces and words that a task remembers beside those of the batch at hand.
REMEMBERED = 300_000
#: Longer pieces are contracted in parts of twice as many bytes, which overlap by half.
STRIDE = 48
#: From so many bytes, equal pairs of a part are contracted together.
LONG_PART = 2 * STRIDE + 1
#: The pattern under which a space and letters are always one match.
LETTERS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What ends a word under that pattern and is a match of its own.
_ENDS = tuple(".,;:")
_NEVER = np.uint64(2**64 - 1)

_SHORT_SQL = """
WITH RECURSIVE s(w, p, np, t, r, k, x) AS (
    SELECT w, p, np, t, r, k, x FROM starts
    UNION ALL
    SELECT * FROM (
        WITH active AS (
            SELECT *, (x >> 32)::INTEGER AS xk, ((x >> 16) & 65535)::INTEGER AS xp, (x & 65535)::INTEGER AS xgone
            FROM s WHERE x IS NOT NULL
        ), gone AS (
            SELECT w, np, r FROM active WHERE p = xgone
        ), changed AS (
            SELECT a.w, a.p, gone.np, a.xk AS t, gone.r FROM active AS a JOIN gone ON a.w = gone.w WHERE a.p = a.xp
            UNION ALL
            SELECT w, p, np, t, xk FROM active WHERE np = xp
        ), now AS (
            SELECT changed.*, merges.k FROM changed LEFT JOIN merges ON lr = t::BIGINT * $base + r
            UNION ALL
            SELECT w, p, np, t, r, k FROM active WHERE p <> xp AND p <> xgone AND np <> xp
        ), best AS (
            SELECT w, min((k::UBIGINT << 32) | (p::UBIGINT << 16) | np::UBIGINT) AS x FROM now GROUP BY w
        )
        SELECT now.*, best.x FROM now JOIN best ON now.w = best.w
    )
), final AS (SELECT (w::BIGINT << 32) | p AS place, t FROM s WHERE x IS NULL)
"""

_LONG_SQL = """
WITH RECURSIVE s(w, p, t, i) AS (
    SELECT w, p, t, 0 FROM starts
    UNION ALL
    SELECT w, p, CASE WHEN kept THEN k ELSE t END, i + 1 FROM (
        SELECT *, lag(kept) OVER (PARTITION BY w ORDER BY p) AS gone FROM (
            SELECT *, hit AND (p = first_hit OR together AND island_row % 2 = 1) AS kept FROM (
                SELECT *, row_number() OVER (PARTITION BY w, hit, island ORDER BY p) AS island_row FROM (
                    SELECT *, n - row_number() OVER (PARTITION BY w, hit ORDER BY p) AS island,
                           min(CASE WHEN hit THEN p END) OVER (PARTITION BY w) AS first_hit FROM (
                        SELECT *, coalesce(k = best, FALSE) AS hit FROM (
                            SELECT x.*, k, together, min(k) OVER (PARTITION BY w) AS best FROM (
                                SELECT s.*, lead(t) OVER o AS r, row_number() OVER o AS n
                                FROM s WINDOW o AS (PARTITION BY w ORDER BY p)
                            ) AS x LEFT JOIN merges ON lr = t::BIGINT * $base + r
                        ) WHERE best IS NOT NULL
                    )
                )
            )
        )
    ) WHERE gone IS NOT TRUE
), last AS (SELECT w, max(i) AS i FROM s GROUP BY w),
final AS (SELECT (s.w::BIGINT << 32) | s.p AS place, s.t FROM s JOIN last ON s.w = last.w AND s.i = last.i)
"""

_RESULT_SQL = """
SELECT list(t ORDER BY place) AS ids, string_agg(latin1, '' ORDER BY place) AS bytes
FROM final JOIN vocabulary ON id = t
"""

_DECODE_SQL = "SELECT string_agg(latin1, '' ORDER BY place) AS bytes FROM given JOIN vocabulary USING (id)"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a file of ``base64(token) rank`` lines."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Encoder:
    """Encodes texts in one Python process."""

    def __init__(self, content: bytes, pattern: str) -> None:
        import re

        import duckdb
        import regex

        self.ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.letters = pattern == LETTERS_PATTERN
        self.token_sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.token_sizes[rank] = len(token)
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.full((256, 256), -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        self.base = len(self.token_sizes)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.full = duckdb.OutOfMemoryException
        self._load_tables()
        # of words and pieces alike: a piece by itself is one match of the pattern
        self.place: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.raw: list[bytes] = []

    def _load_tables(self) -> None:
        ranks = self.ranks
        rows = [(a, b, k) for token, k in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        least = np.full(len(self.token_sizes), np.iinfo(np.int64).max)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        # together: no pair with the new token comes before the pair that made it
        merges = pa.table({"lr": left * self.base + right, "k": rank.astype(np.int32), "together": least[rank] > rank})
        words = pa.table({"id": pa.array(ranks.values(), pa.int32()), "latin1": [t.decode("latin-1") for t in ranks]})
        for name, table in (("merges", merges), ("vocabulary", words)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _contract(self, pieces: list[bytes], sql: str) -> tuple[list[bytes], list[bytes]]:
        """ids (little-endian int32) and decoded bytes of pieces of two bytes or more."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        place = np.arange(len(raw)) - np.repeat(begins, sizes)
        tokens = self.first[raw]
        following = np.r_[tokens[1:], np.int32(-1)]
        pair = self.pairs[raw, np.r_[raw[1:], np.uint8(0)]]
        following[ends - 1] = pair[ends - 1] = -1
        key = (pair.astype(np.uint64) << np.uint64(32)) | (place.astype(np.uint64) << np.uint64(16)) | (place + 1).astype(np.uint64)
        key[pair < 0] = _NEVER
        best = np.repeat(np.minimum.reduceat(key, begins), sizes)
        starts = pa.table({
            "w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes), "p": place.astype(np.int32), "np": (place + 1).astype(np.int32),
            "t": tokens, "r": following, "k": pa.array(pair.astype(np.int32), mask=pair < 0), "x": pa.array(best, mask=best == _NEVER),
        })
        self.db.register("starts", starts)
        try:
            out = self.db.sql((sql + _RESULT_SQL).replace("$base", str(self.base))).to_arrow_table()
        except self.full:
            if len(pieces) < 2:
                raise
            out = None
        finally:
            self.db.unregister("starts")
        if out is None:
            half = len(pieces) // 2
            return tuple(a + b for a, b in zip(self._contract(pieces[:half], sql), self._contract(pieces[half:], sql), strict=True))
        ids = out.column("ids").combine_chunks().values.to_numpy().astype(np.int32, copy=False)
        decoded = out.column("bytes")[0].as_py().encode("latin-1")
        upto = np.r_[0, np.searchsorted(np.cumsum(self.token_sizes[ids]), ends) + 1] * 4
        flat = ids.tobytes()
        lists = [flat[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return lists, [decoded[i:j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _contract_all(self, parts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """ids and decoded bytes of many parts, in queries of bounded work."""
        ids, decoded = [b""] * len(parts), [b""] * len(parts)
        for sql, wanted in ((_SHORT_SQL, lambda n: n < LONG_PART), (_LONG_SQL, lambda n: n >= LONG_PART)):
            block, work = [], 0
            todo = [i for i, x in enumerate(parts) if wanted(len(x))]
            for k, i in enumerate(todo):
                block.append(i)
                work += len(parts[i]) ** 2
                if work >= BLOCK_SQUARES or len(block) >= BLOCK_PIECES or k + 1 == len(todo):
                    for j, a, b in zip(block, *self._contract([parts[j] for j in block], sql), strict=True):
                        ids[j], decoded[j] = a, b
                    block, work = [], 0
        return ids, decoded

    def _shared_token(self, left: tuple, right: tuple) -> tuple[int, int] | None:
        """The places in both of a token that two overlapping parts have in common."""
        (begin, _, ids), (other, _, others) = left, right
        ends = begin + np.cumsum(self.token_sizes[ids])
        first = int(np.searchsorted(ends - self.token_sizes[ids], other))
        their_ends = other + np.cumsum(self.token_sizes[others])
        mine = (ends[first:] << 8) | self.token_sizes[ids[first:]]
        theirs = (their_ends << 8) | self.token_sizes[others]
        _, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        return (first + int(i[0]), int(j[0])) if len(i) else None

    def _encode_long(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of long pieces, from parts that overlap."""
        pieces = [[(at, min(at + 2 * STRIDE, len(raw)), None) for at in range(0, max(1, len(raw) - STRIDE), STRIDE)] for raw in raws]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raws)
        open_ = list(range(len(raws)))
        while open_:
            todo = [(w, k) for w in open_ for k, part in enumerate(pieces[w]) if part[2] is None]
            needed = [raws[w][pieces[w][k][0] : pieces[w][k][1]] for w, k in todo]
            different = list(dict.fromkeys(needed))
            found = dict(zip(different, self._contract_all(different)[0], strict=True))
            for (w, k), part in zip(todo, needed, strict=True):
                pieces[w][k] = (*pieces[w][k][:2], np.frombuffer(found[part], np.int32))
            still = []
            for w in open_:
                made, cuts, parts = [], [(0, 0)], pieces[w]
                for part in parts:
                    shared = None
                    if made and made[-1][2] is not None and (shared := self._shared_token(made[-1], part)) is None:
                        made[-1] = (made[-1][0], part[1], None)  # one longer part
                    else:
                        made.append(part)
                        cuts.append(shared)
                if len(made) < len(parts):
                    pieces[w] = made
                    still.append(w)
                    continue
                starts = [0, *(c[1] + 1 for c in cuts[2:])]
                stops = [*(c[0] + 1 for c in cuts[2:]), len(made[-1][2])]
                out[w] = np.concatenate([part[2][i:j] for part, i, j in zip(made, starts, stops, strict=True)])
            open_ = still
        return out

    def _decode(self, pieces: list[np.ndarray]) -> list[bytes]:
        ids = np.concatenate(pieces)
        self.db.register("given", pa.table({"place": np.arange(len(ids)), "id": ids}))
        found = self.db.sql(_DECODE_SQL).fetchall()[0][0].encode("latin-1")
        self.db.unregister("given")
        ends = np.cumsum([int(self.token_sizes[p].sum()) for p in pieces]).tolist()
        return [found[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _remember(self, words: Collection[str], ids: Iterable[bytes], raw: Iterable[bytes]) -> None:
        first = len(self.ids)
        self.ids += ids
        self.raw += raw
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def _encode_pieces(self, pieces: set[str]) -> None:
        """Add the ids and decoded bytes of unknown pieces."""
        ranks = self.ranks
        known, short, long = {}, {}, []
        for piece in pieces:
            data = piece.encode()
            if data in ranks:
                known[piece] = data
            elif len(data) > 2 * STRIDE:
                long.append((piece, data))
            else:
                short[piece] = data
        self._remember(known, [ranks[data].to_bytes(4, "little") for data in known.values()], known.values())
        self._remember(short, *self._contract_all(list(short.values())))
        for at in range(0, len(long), 1024):
            part = long[at : at + 1024]
            found = self._encode_long([raw for _, raw in part])
            self._remember([piece for piece, _ in part], [ids.tobytes() for ids in found], self._decode(found))

    def _learn(self, words: set[str]) -> None:
        missing = words.difference(self.place)
        # words that are one match need no list of their pieces
        whole = {w for w in missing if w[:1] == " " and w[1:].isalpha()} if self.letters else set()
        pairs, several = [], {}
        for word in missing.difference(whole):
            if self.letters and word[:1] == " " and word[-1] in _ENDS and word[1:-1].isalpha():
                pairs.append(word)
            else:
                several[word] = self.pattern.findall(word)
        unknown = whole.union([w[:-1] for w in pairs], [w[-1] for w in pairs], *several.values())
        self._encode_pieces(unknown.difference(self.place))
        place, ids, raw = self.place, self.ids, self.raw
        parts = [(place[w[:-1]], place[w[-1]]) for w in pairs]
        self._remember(pairs, [ids[i] + ids[j] for i, j in parts], [raw[i] + raw[j] for i, j in parts])
        several = {w: [place[p] for p in pieces] for w, pieces in several.items() if len(pieces) != 1}
        self._remember(several, [b"".join([ids[i] for i in x]) for x in several.values()], [b"".join([raw[i] for i in x]) for x in several.values()])

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian int32, decoded bytes) of each text."""
        cut = [x.replace(" ", "\0 ").split("\0") if "\0" not in x else None for x in texts]
        used = set().union(*filter(None, cut))
        loose = {w for w in used if w[:1] == " " and (w == " " or w != " " + w.strip())}
        again = False
        for i, (text, words) in enumerate(zip(texts, cut, strict=True)):
            if words is None or not words[0] or words[0] != words[0].strip() or loose and not loose.isdisjoint(words):
                words = self.cut.split(text)
                cut[i] = words[:1] + [" " + w for w in words[1:]]
                again = True
        if again:
            used = set().union(*cut)
        if len(self.place) > REMEMBERED:
            kept = [w for w in used if w in self.place]
            places = [self.place[w] for w in kept]
            ids, raw = [self.ids[i] for i in places], [self.raw[i] for i in places]
            self.place, self.ids, self.raw = {}, [], []
            self._remember(kept, ids, raw)
        self._learn(used)
        place, ids, raw = self.place.__getitem__, self.ids.__getitem__, self.raw.__getitem__
        out = []
        for words in cut:
            places = list(map(place, words))
            out.append((b"".join(map(ids, places)), b"".join(map(raw, places))))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """The encoder of this process for a vocabulary and a pattern."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Close the encoders of this process, which outlives its tasks."""
    for each in _ENCODERS.values():
        each.db.close()
    _ENCODERS.clear()


def text_runs(batch: pa.RecordBatch, column: int, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of ``batch`` of bounded text, with the texts (null: empty)."""
    texts = batch.column(column).cast(pa.binary())
    start, held, size = 0, [], 0
    for i in range(len(texts)):
        raw = texts[i].as_py() or b""
        held.append(raw.decode("utf-8", "replace"))
        size += len(raw)
        if size >= most or i + 1 == len(texts):
            yield batch.slice(start, i + 1 - start), held
            start, held, size = i + 1, [], 0


def _id_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The bytes of a vocabulary file, by a local path or any that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as file:
        return file.read()


def _encoding(vocabulary, pattern: str) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 * TEXT_ROWS):
            for part, texts in text_runs(batch, 1):
                made = encoder(vocabulary.value, pattern)
                gc.disable()  # many lists, no cycles
                try:
                    found = made.encode(texts)
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _id_lists([a for a, _ in found]), pa.array([b for _, b in found], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    return leaving_nothing(run, forget_encoders)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(spark, path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoding(vocabulary, pattern), f"doc_id {kind}, ids array<int>, decoded binary")
