"""Information-theoretic sanitisation of personal data.

Protected entities are found by pattern: e-mail addresses, IP addresses, card
numbers and phone numbers.  An entity is a value, and also what many values
share: the domain of an address, the network of an IP address.  A term (a word
of three letters or more, in lower case, outside e-mail addresses) discloses an
entity as far as seeing the term in a text tells of the entity.  There is one
event for all counts, that a different text holds a thing: with N texts and
the texts that hold the term, the entity and both,

    disclosure = log2(N * both / (term * entity)) / log2(N / entity) * (1 - 2 ** -both)

The quotient is 1 when the term occurs with the entity only; the last factor
smooths it, so that chance meetings in few texts weigh little.  Every occurrence
of a term in the texts of an entity is generalised from ``GENERALISE`` on and
removed from ``REMOVE`` on.  Exact copies count as one text.

Everything is DataFrame operations.  One pass over the texts writes the matches
to a scratch table; offsets are running sums within a document.  A second reads
the terms of texts with an entity that another text has too, a third counts the
terms of all texts, a last one places disclosing terms.  A text is given only
those disclosing terms that it holds.  Counts are combined before they are
shuffled; tables are broadcast if they are few by count and bytes and joined
otherwise.

Defined cases: a null text is an empty one; a null ``doc_id`` stays; repeated
rows stay repeated; matches that fail their test are dropped without another
try; a term that overlaps a match is not added; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import few, fresh, keep

#: Fixed patterns of the four kinds, in their order.  Repetitions that cannot
#: give back are possessive, and a run is entered at its start only (or where
#: the last match ended), so that scanning stays linear.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[WORD]", "remove": ""}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
LETTERS = 3
GENERALISE, REMOVE = 0.6, 0.9
_NOT_LETTERS = r"[^\p{L}]+"


def _hits(kind: str, matches: Column, gaps: Column) -> Column:
    def one(match: Column, i: Column) -> Column:
        before = F.get(gaps, i)
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            match.alias("value"),
            F.char_length(before).alias("gap"),
            F.octet_length(before).alias("gap_bytes"),
        )

    return F.transform(matches, one)


def _matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, mark and hits of every document, written to scratch."""
    text = F.coalesce("text", F.lit(""))
    table = docs.select("doc_id", F.xxhash64("text").alias("mark"), text.alias("text"))
    for kind, pattern in PATTERNS.items():
        table = table.withColumn(f"gaps_{kind}", F.split("text", pattern, -1)).withColumn(f"hits_{kind}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    table = table.select("doc_id", "mark", F.concat(*(_hits(k, F.col(f"hits_{k}"), F.col(f"gaps_{k}")) for k in KINDS)).alias("hits"))
    return keep(table.select(F.monotonically_increasing_id().alias("row"), "*"), "matches")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    ascending = F.split(F.reverse(_digits(value)), "")

    def one(digit: Column, i: Column) -> Column:
        d = digit.try_cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    points = F.transform(F.filter(ascending, lambda x: x != ""), one)
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.char_length(_digits(value))
    return (
        F.when(kind == "ip", value.rlike(_IP))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(value)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _base_spans(matches: DataFrame) -> DataFrame:
    """One row for each valid match, with its place in characters and bytes."""
    hits = matches.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size, size_bytes = F.char_length("value"), F.octet_length("value")
    ends = hits.select(
        "*",
        F.sum(F.col("gap").cast("long") + size).over(upto).alias("end"),
        F.sum(F.col("gap_bytes").cast("long") + size_bytes).over(upto).alias("end_byte"),
    )
    placed = ends.withColumn("start", F.col("end") - size).withColumn("start_byte", F.col("end_byte") - size_bytes)
    return placed.where(_valid(F.col("kind"), F.col("value")))


def _entities(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """(mark, entity) of the values in each text and of what values share."""
    value = F.lower("value")
    each = F.array_compact(
        F.array(
            F.concat_ws(":", "kind", value),
            F.when(F.col("kind") == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1))),
            F.when(F.col("kind") == "ip", F.concat(F.lit("network:"), F.substring_index(value, ".", 2))),
        )
    )
    rows = spans.select("row", F.explode(each).alias("entity"))
    return rows.join(few(matches.where(F.size("hits") > 0).select("row", "mark"), "rows"), "row").select("mark", "entity").distinct()


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit(" "))).otherwise(text)
    return F.filter(F.array_distinct(F.split(F.lower(bare), _NOT_LETTERS)), lambda w: F.char_length(w) >= LETTERS)


def _with_entities(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(mark, text, entities) of the different texts of ``docs`` that ``entities``
    (mark, entity) names."""
    wanted = keep(entities.groupBy("mark").agg(F.collect_set("entity").alias("entities")), "wanted")
    held = docs.join(few(wanted.select("mark"), "marks"), "mark", "left_semi").dropDuplicates(["mark"])
    return held.join(wanted, "mark")


def disclosing_terms(docs: DataFrame, entities: DataFrame, copies: DataFrame, n_texts: int) -> DataFrame:
    """(entity, term, disclosure) of the pairs at ``GENERALISE`` or above.

    ``docs`` has (mark, text), ``entities`` (mark, entity) and ``copies`` (mark,
    rows) of the texts that several rows have.
    """
    known = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_texts"))
    # a pair of one text alone is smoothed to one half at most
    known = few(known.where("entity_texts > 1"), "entities")
    texts = _with_entities(docs, entities.join(known, "entity").select("mark", "entity"))
    met = texts.select(F.explode(_terms(F.col("text"))).alias("term"), "entities").select("term", F.explode("entities").alias("entity"))
    pairs = keep(met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where("both > 1"), "pairs")
    # every copy of a text counts by its share, so that the text counts once
    share = docs.join(few(copies, "copies"), "mark", "left").select((1 / F.coalesce("rows", F.lit(1))).alias("share"), "text")
    counted = share.select(F.explode(_terms(F.col("text"))).alias("term"), "share").groupBy("term").agg(F.round(F.sum("share")).alias("term_texts"))
    joined = pairs.join(known, "entity").join(counted, "term")
    n = F.lit(float(n_texts))
    most = F.log2(n / F.col("entity_texts"))
    told = F.log2(n * F.col("both") / (F.col("term_texts") * F.col("entity_texts")))
    ratio = F.when(most > 0, told / F.when(most > 0, most)) * (1 - F.pow(F.lit(2.0), -F.col("both")))
    return joined.select("entity", "term", ratio.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def _terms_to_place(texts: DataFrame, telling: DataFrame) -> DataFrame:
    """(mark, terms), a map of term to kind, of the words of ``texts`` (mark,
    text, entities) that disclose an entity of their text."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower))
    met = texts.select("mark", F.explode(F.filter(words, lambda w: F.char_length(w) >= LETTERS)).alias("term"), "entities")
    kind = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise")
    told = few(telling.select("entity", "term", kind.alias("kind")), "told")
    found = met.select("mark", "term", F.explode("entities").alias("entity")).join(told, ["entity", "term"]).groupBy("mark", "term").agg(F.max("kind").alias("kind"))
    return found.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("terms"))


def _places(texts: DataFrame) -> DataFrame:
    """(mark, start, end, start_byte, end_byte, kind) of each occurrence of the
    ``terms`` (map of term to kind) of the different ``texts`` (mark, text, terms)."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    listed = F.zip_with(words, F.split("text", r"\p{L}+", -1), lambda w, gap: F.struct(w.alias("word"), F.char_length(gap).alias("gap"), F.octet_length(gap).alias("gap_bytes")))
    rows = texts.select("mark", "terms", F.posexplode(listed).alias("i", "w")).where("w.word is not null")
    kind = F.element_at("terms", F.lower("w.word"))
    sized = rows.select("mark", "i", kind.alias("kind"), F.char_length("w.word").alias("n"), F.octet_length("w.word").alias("n_bytes"), "w.gap", "w.gap_bytes")
    upto = Window.partitionBy("mark").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end, end_byte = F.sum(F.col("gap").cast("long") + F.col("n")).over(upto), F.sum(F.col("gap_bytes").cast("long") + F.col("n_bytes")).over(upto)
    ends = sized.select("*", end.alias("end"), end_byte.alias("end_byte")).where("kind is not null")
    return ends.select("mark", (F.col("end") - F.col("n")).alias("start"), "end", (F.col("end_byte") - F.col("n_bytes")).alias("start_byte"), "end_byte", "kind")


def find_pii(docs: DataFrame) -> DataFrame:
    """row, doc_id, mark, base and added spans of every document.

    ``base`` has (start, rank, kind, end, start_byte, end_byte) of the pattern
    matches in order; ``added`` the same of disclosing terms, with the kinds
    generalise and remove.
    """
    matches = _matches(docs)
    spans = keep(_base_spans(matches), "spans")
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, "generalise", "remove"])), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "kind", "end", "start_byte", "end_byte")
    base = spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("base"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,start_byte:bigint,end_byte:bigint>>")
    found = matches.select("row", "doc_id", "mark").join(base, "row", "left").withColumn("base", F.coalesce("base", empty))
    telling, entities, texts = None, keep(_entities(spans, matches), "entities"), docs.select(F.xxhash64("text").alias("mark"), "text").where("text is not null")
    if entities.take(1):
        copies = keep(matches.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")), "copies")
        telling = keep(disclosing_terms(texts, entities, copies.where("rows > 1"), copies.count()), "telling")
    if telling is None or not telling.take(1):
        return found.withColumn("added", empty)
    named = entities.join(few(telling.select("entity").distinct(), "named"), "entity", "left_semi").select("mark", "entity")
    meant = keep(_with_entities(texts, named), "meant")
    placed = _places(meant.join(few(_terms_to_place(meant, telling), "terms"), "mark").select("mark", "text", "terms"))
    placed = keep(placed.groupBy("mark").agg(F.array_sort(F.collect_list(span)).alias("placed")), "placed")
    apart = F.filter("placed", lambda p: ~F.exists("base", lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])))
    return found.join(placed, "mark", "left").select("row", "doc_id", "mark", "base", F.coalesce(apart, empty).alias("added"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its placeholder in ``text``.

    Where spans overlap, the first one by place counts.  Rows without a span
    stay as they are, null texts included.
    """
    mark, cuts, key = (fresh(docs, x) for x in ("text_mark", "cuts", "cut_id"))
    found = find_pii(docs).select("doc_id", "mark", F.array_sort(F.concat("base", "added")).alias("spans")).where(F.size("spans") > 0)
    found = found.dropDuplicates(["doc_id", "mark"])

    def apart(kept: Column, s: Column) -> Column:
        free = (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["end_byte"] <= s["start_byte"])
        return F.when(free, F.concat(kept, F.array(s))).otherwise(kept)

    kind = found.schema["spans"].dataType.simpleString()
    found = found.withColumn("spans", F.aggregate("spans", F.array().cast(kind), apart))
    found = found.select(F.col("doc_id").alias(key), F.col("mark").alias(f"{mark}_"), F.col("spans").alias(cuts))
    marked = docs.withColumn(mark, F.xxhash64("text"))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(f"{mark}_")), "left")
    raw = F.encode("text", "UTF-8")
    names = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(cuts), i - 1)["end_byte"])
        between = F.substring(raw, (begin + 1).cast("int"), (s["start_byte"] - begin).cast("int"))
        return F.concat(F.decode(between, "UTF-8"), F.element_at(names, s["kind"]))

    tail = F.substring(raw, (F.element_at(F.col(cuts), -1)["end_byte"] + 1).cast("int"), F.octet_length("text"))
    text = F.concat(F.array_join(F.transform(F.col(cuts), piece), ""), F.decode(tail, "UTF-8"))
    out = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(text)
    return joined.select(*(out.alias(c) if c == "text" else F.col(c) for c in docs.columns))
