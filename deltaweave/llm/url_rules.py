"""URL filtering by explicit rules and by association rules that FP-growth mines.

An explicit rule (host, path prefix) fits its host and all subdomains; the
longest that fits decides.  For the rest, labelled pages become baskets of URL
tokens (labels of the host, path segments without digits, query names) with the
label as one more item; Spark's FP-growth mines them, and rules from tokens to
the blocking label stay if they reach a support and a confidence, whatever
their length.  The rules form an inverted index from token to rule, joined with
the tokens of each distinct token set; a rule whose tokens are all met blocks
the page.

Token sets, not pages, are joined: pages with equal tokens share one row, so a
hot host is counted once.  The mined rules are bounded by the support.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no tokens, and is allowed; a null page id stays; repeated rows stay repeated; a
label counts once for a page; with no blocking label nothing is mined and
everything else is allowed; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: The explicit rules as (verdict, host, path prefix).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.002, 10, 0.8
BLOCKED = "label:block"


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """The text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: str, path: str) -> str:
    return host + path


def explicit_rule(host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(RULES, key=lambda r: (len(_name(*r[1:])), r[1:])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(_name(name, prefix)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    host = F.transform(F.filter(F.split(host_of(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    path = F.filter(F.split(path_of(url), "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    parts = F.concat(
        host,
        F.transform(path, lambda x: F.concat(F.lit("path:"), F.lower(x))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
    )
    return F.coalesce(F.sort_array(F.array_distinct(parts)), F.array().cast("array<string>"))


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Rules (rule_id, tokens) and groups (token, name) of rows (tokens, bad);
    None if there are no rules.

    Tokens that occur in the same labelled pages are one item, and one that alone
    is a rule takes no part in longer ones, which it makes needless; so itemsets
    do not multiply with tokens that say the same.  A rule names its items, and
    any token of an item meets it, as all have the same support and confidence.
    """
    baskets = labelled.where((F.size("tokens") > 0) | F.col("bad")).withColumn("basket", F.monotonically_increasing_id())
    baskets = keep(baskets.select("basket", "tokens", "bad"), "baskets")
    needed = max(math.ceil(MIN_SUPPORT * baskets.count()), MIN_COUNT)
    each = baskets.select("basket", "bad", F.explode("tokens").alias("token"))
    found = each.groupBy("token").agg(
        F.count_if("bad").alias("n_bad"),
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("basket")).alias("x"),
        F.bit_xor(F.xxhash64("basket", F.lit("second"))).alias("y"),
    )
    # tokens that are never met with the label often enough are in no rule
    often = found.where(F.col("n_bad") >= needed)
    names = often.groupBy("n", "x", "y").agg(F.min("token").alias("name"), F.max(F.col("n_bad") / F.col("n")).alias("confidence"), F.collect_list("token").alias("tokens"))
    names = keep(names, "names")
    groups = names.select(F.explode("tokens").alias("token"), "name")
    alone = names.where(F.col("confidence") >= MIN_CONFIDENCE)
    rules = alone.select(F.array("name").alias("tokens"))
    others = names.join(alone.select("name"), "name", "left_anti").select(F.explode("tokens").alias("token"), "name")
    items = each.join(others, "token").groupBy("basket").agg(F.collect_set("name").alias("items"), F.first("bad").alias("bad"))
    items = keep(items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items")).alias("items")), "items")
    n_items = items.count()
    if n_items >= needed:
        model = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / n_items, minConfidence=MIN_CONFIDENCE).fit(items)
        longer = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED))
        rules = rules.unionByName(longer.select(F.sort_array("antecedent").alias("tokens")))
    rules = keep(rules.withColumn("rule_id", F.xxhash64("tokens")), "rules")
    return (rules, groups) if rules.take(1) else None


def blocked_sets(sets: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """(key) of the token sets (key, tokens) that hold all items of some rule."""
    index = rules.select("rule_id", F.size("tokens").alias("needed"), F.explode("tokens").alias("name"))
    named = sets.select("key", F.explode("tokens").alias("token")).join(groups, "token").select("key", "name").distinct()
    counted = named.join(index, "name").groupBy("key", "rule_id", "needed").agg(F.count(F.lit(1)).alias("met"))
    return counted.where("met = needed").select("key").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``labels`` has page_id and bad (boolean).
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    parsed = keep(parsed.withColumn("key", F.xxhash64("tokens")), "parsed")
    known = labels.where("page_id is not null").groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    mined = mine(parsed.join(known, "page_id").select("tokens", "bad"))
    out = parsed.withColumn("fits", explicit_rule(F.col("host"), F.col("path")))
    if mined is None:
        other = F.lit("allow")
    else:
        sets = parsed.groupBy("key").agg(F.first("tokens").alias("tokens"))
        out = out.join(blocked_sets(sets, *mined).withColumn("hit", F.lit(True)), "key", "left")
        other = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", other).alias("verdict"))
