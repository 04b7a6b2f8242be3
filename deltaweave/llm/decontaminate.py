"""Benchmark decontamination by winnowed k-gram fingerprints.

The 5-gram hashes of a text are winnowed: of every six in a row (the 5-grams of
a 10-word window) the least is kept, the rightmost of equal ones, with its
place.  So every shared span of ten words or more shares a fingerprint, while
some two words in seven keep one.  Fingerprints of documents meet those of
benchmark items by an equality join; a hit carries the few words around it and
extends to the windows that hold it, which are compared by their words.  Windows
that touch become spans.  A benchmark item of fewer words is one window of its
length, fingerprinted whole.

All of it is DataFrame operations.  Each document sends its fingerprints through
two joins, on fingerprints and on the words of windows; the benchmark's side is
broadcast if its count and bytes are small, else both are joins of Spark's
choice.  Fingerprints without a hit are dropped before the shuffle by row.
Items that share a window share one row of the joined table, and windows of the
same items one list of ids, so hits do not multiply with them.

Defined cases: a null text has no words and no hits; an item with a null or
wordless text is no window; words of an item with a null id are hit like any,
but the item has no place in the list; repeated item ids count once; repeated
document rows stay repeated; other columns are ignored; an empty table on either
side gives the documents without hits.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, keep

WINDOW_WORDS, GRAM_WORDS = 10, 5
#: Benchmark windows up to this number and these bytes of words are broadcast.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: 5-grams in a window, and words around a fingerprint that hold all its windows.
_GRAMS = WINDOW_WORDS - GRAM_WORDS + 1
_AROUND = 2 * WINDOW_WORDS - GRAM_WORDS


def words_of(text: Column) -> Column:
    """The words of a text: ASCII lower case and digits, and all beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_A_WORD), "")


def _hash_at(hashes: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(hashes, i + c) for c in range(n)))


def _indexes(n: Column) -> Column:
    """0 to n - 1; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _entry(length: int, at: Column, key: Column, low: Column, words: Column) -> Column:
    """A fingerprint: the length of its windows, its place and hash, and the words
    around it from place ``low`` on."""
    return F.struct(F.lit(length).alias("len"), at.alias("at"), key.alias("key"), low.alias("low"), words.alias("words"))


def _winnowed(hashed: DataFrame) -> DataFrame:
    """``hashed`` with ``_places``, the places of the fingerprints in ascending order.

    The three lowest bits of a gram are zero; they take its distance from the
    window's end, so the least number is the rightmost of the least hashes.  Each
    step is a projection of its own: a lambda must not compute an array again.
    """
    grams = F.col("_grams")
    least = F.transform(_indexes(F.col("n_words") - (WINDOW_WORDS - 1)), lambda i: F.least(*(F.get(grams, i + c) + (_GRAMS - 1 - c) for c in range(_GRAMS))))
    ends = F.transform(least, lambda v, i: i + (_GRAMS - 1) - v.bitwiseAND(F.lit(7)).cast("int"))
    return hashed.withColumn("_ends", ends).withColumn("_places", F.filter("_ends", lambda p, i: (i == 0) | (p != F.get(F.col("_ends"), i - 1))))


def _fingerprints(table: DataFrame) -> Column:
    """Entries of a text of ten words or more, with the words around each."""

    def one(p: Column) -> Column:
        low = F.greatest(p - (_GRAMS - 1), F.lit(0))
        return _entry(WINDOW_WORDS, p, F.get(table["_grams"], p), low, F.slice(table["_words"], low + 1, F.lit(_AROUND)))

    return F.transform(table["_places"], one)


def _short_windows(table: DataFrame, length: int) -> Column:
    def one(i: Column) -> Column:
        return _entry(length, i, _hash_at(table["_hashes"], i, length), i, F.slice(table["_words"], i + 1, F.lit(length)))

    return F.transform(_indexes(table["n_words"] - (length - 1)), one)


def _hashed(table: DataFrame, text: str, *others: Column) -> DataFrame:
    """The other columns with n_words, words, their hashes, 5-grams and fingerprints."""
    words = table.select(*others, words_of(F.col(text)).alias("_words"))
    hashes = words.select("*", F.size("_words").alias("n_words"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    grams = F.transform(_indexes(F.col("n_words") - (GRAM_WORDS - 1)), lambda i: _hash_at(F.col("_hashes"), i, GRAM_WORDS).bitwiseAND(F.lit(-8)))
    return _winnowed(hashes.withColumn("_grams", grams))


def benchmark_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (len, key), windows (len, window, list) and lists (list, items).

    ``window`` has the words with spaces between them; windows of the same items
    share one ``list``.
    """
    items = _hashed(benchmark, "text", F.col("item_id").cast("string").alias("item")).where("n_words > 0")
    items = keep(items, "items")
    n = F.col("n_words")
    short = lambda k: F.array(_entry(k, F.lit(0), _hash_at(F.col("_hashes"), F.lit(0), k), F.lit(0), F.col("_words")))
    prints = reduce(lambda other, k: F.when(n == k, short(k)).otherwise(other), range(1, WINDOW_WORDS), _fingerprints(items))
    keys = keep(items.select(F.explode(prints).alias("f")).select("f.len", "f.key").distinct(), "fingerprints")
    length = F.least(n, F.lit(WINDOW_WORDS))
    each = F.transform(_indexes(n - length + 1), lambda i: F.array_join(F.slice("_words", i + 1, length), " "))
    windows = items.select("item", length.alias("len"), F.explode(each).alias("window")).groupBy("len", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = keep(windows.withColumn("list", F.sha2(F.array_join("items", ","), 256)), "windows")
    return keys, listed.select("len", "window", "list"), keep(listed.select("list", "items").dropDuplicates(["list"]), "lists")


def _small(table: DataFrame, size: Column) -> DataFrame:
    """``table``, broadcast in joins if its rows and bytes are few."""
    row = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(table) if row[0] <= BROADCAST_WINDOWS and row[1] <= BROADCAST_BYTES else table


def _probed(docs: DataFrame, benchmark: DataFrame, *others: Column) -> DataFrame:
    """The other columns with n_words and each hit (len, at, items).

    Every row of ``docs`` also has one row of its own with ``at`` -1.
    """
    keys, windows, lists = benchmark_tables(benchmark)
    lengths = [row["len"] for row in keys.groupBy("len").count().orderBy("len").collect()]
    hashed = _hashed(docs, "text", *others)
    names = [c for c in hashed.columns if not c.startswith("_")]
    none = F.lit(None)
    entries = [F.array(_entry(0, F.lit(-1), none.cast("long"), F.lit(0), none.cast("array<string>")))]
    if WINDOW_WORDS in lengths:
        entries.append(_fingerprints(hashed))
    entries += [_short_windows(hashed, k) for k in lengths if k < WINDOW_WORDS]
    probes = hashed.select(*names, F.explode(F.concat(*entries)).alias("f")).select(*names, "f.*")
    met = probes.join(_small(keys.withColumn("met", F.lit(True)), F.lit(16)), ["len", "key"], "left").where("at < 0 or met")
    # a fingerprint extends to the windows that hold it
    last = F.least(F.col("at"), F.col("n_words") - F.col("len"))
    around = F.transform(
        F.sequence("low", F.greatest(F.col("low"), last)),
        lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i - F.col("low") + 1, F.col("len")), " ").alias("window")),
    )
    own = F.array(F.struct(F.lit(-1).alias("at"), none.cast("string").alias("window")))
    extended = met.select(*names, "len", F.explode(F.when(F.col("at") < 0, own).otherwise(around)).alias("w")).select(*names, "len", "w.at", "w.window")
    found = extended.join(_small(windows, F.octet_length("window") + 80), ["len", "window"], "left").where("at < 0 or list is not null")
    return found.join(_small(lists, 24 * F.size("items") + 80), "list", "left").select(*names, "len", "at", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids) and spans of every row.

    ``spans`` has the maximal hit word ranges as (begin, end), end exclusive.
    """
    found = _probed(docs, benchmark, F.col("doc_id"), F.monotonically_increasing_id().alias("row"))
    hit = F.when(F.col("at") >= 0, F.struct("at", (F.col("at") + F.col("len")).alias("end")))
    grouped = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = F.aggregate("hits", F.array().cast("array<struct<begin:int,end:int>>"), _extend)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]).cast("long"))
    return grouped.withColumn("spans", spans).select("doc_id", "n_words", total.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any benchmark item."""
    mark = fresh(docs, "text_mark")
    found = _probed(docs, benchmark, F.col("doc_id").alias("hit_id"), F.xxhash64("text").alias("hit_mark"))
    found = keep(found.where("at >= 0").select("hit_id", "hit_mark").distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col(mark) == F.col("hit_mark"))
    return docs.withColumn(mark, F.xxhash64("text")).join(found, same, "left_anti").drop(mark)


def _extend(spans: Column, hit: Column) -> Column:
    """Join a hit to the last span if they touch; hits come in order."""
    last = F.element_at(spans, -1)
    joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], hit["end"]).alias("end"))
    added = F.struct(hit["at"].alias("begin"), hit["end"].alias("end"))
    touching = (F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= hit["at"])
    return F.when(touching, F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(joined))).otherwise(F.concat(spans, F.array(added)))
