"""The training-data operators against brute force, SQL and defined edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deltaweave.llm import (
    ann_search,
    byte_bpe,
    components,
    decontaminate,
    language_id,
    license_scan,
    line_dedup,
    pii,
    queries,
    scratch,
    simhash_dedup,
    token_pack,
    url_rules,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents of (doc_id, text) or (doc_id, text, source), with a clashing column."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOC).withColumn("Fingerprint", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("hits", F.lit(0))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(name, spark, sf_dir, same_rows):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


# 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


PII_EDGES = [
    (None, "x"), (1, None), (2, ""), (3, "a@b.c_x@y.z a@b.c@d.e é🙂 1.2.3.4.5.6.7.8 300.1.1.1 00255.1.1.001"),
    (4, "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (555) 123-4567. +44 20 7946 0958"), (5, "a" * 50000), (6, "1 " * 40000),
    (7, "a@b" + ".c" * 20000), (8, "+1" + " " * 3000 + "x"), (9, "x@y.z " * 3000), (3, "a@b.c"), (3, "a@b.c"), (10, "%+a@b-.c- .a@b.c..d@e.f"),
]


def test_pii_base_spans(spark):
    rows = queries.span_digests(pii.find_pii(docs(spark, PII_EDGES))).collect()
    want = Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest(), base_spans(t)) for i, t in PII_EDGES)
    assert Counter((r["doc_id"], r["base_sha256"], r["spans"]) for r in rows) == want
    for r in rows:
        kinds = Counter(s.split(":")[0] for s in r["spans"].split(",") if s)
        assert all(r[f"n_{k}"] == kinds[k] for k in pii.KINDS)


def test_pii_terms_that_disclose_are_added(spark):
    rows = [(i, f"line {w} the Zebulon wrote from zeb@example.com the {w} other") for i, w in enumerate(["apple", "berry", "cherry", "dates"])]
    rows += [(100 + i, f"the other line wrote from {w}") for i, w in enumerate(["fig", "grape"] * 30)]
    copies = [(300 + i, "the Quillon says quill@example.org today") for i in range(5)]
    found = {r["doc_id"]: r for r in pii.find_pii(docs(spark, rows + copies)).collect()}
    for i, text in rows[:4]:
        added = [(text[s["start"] : s["end"]], s["kind"]) for s in found[i]["added"]]
        assert added == [("Zebulon", "remove")]
    assert all(not found[i]["added"] for i, _ in rows[4:] + copies)  # copies are one context
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert clean[0] == "line apple the  wrote from [EMAIL] the apple other" and clean[100] == rows[4][1]


def test_pii_terms_by_brute_force(spark):
    """Disclosure over different texts, for values and what they share."""
    rnd = random.Random(2)
    vocabulary_ = [f"{a}{b}word" for a in "abcdefgh" for b in "xyz"]
    rows = []
    for i in range(60):
        words = rnd.sample(vocabulary_, 6)
        if i % 4 == 0:
            words += ["Secret", f"u{i % 8}@hidden.org", "secret"]
        if i % 5 == 0:
            words += [f"10.7.{i}.1", "Netname"] + (["çedille"] if i % 2 else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(100, rows[0][1]), (101, rows[4][1]), (102, None), (103, "")]
    texts = sorted({t for _, t in rows if t is not None} | {None}, key=str)
    held, terms = {}, {}
    for t in texts:
        plain_ = re.sub(BASE["email"], " ", t or "")
        terms[t] = {w for w in re.findall(r"[^\W\d_]+", plain_.lower()) if len(w) >= 3}
        held[t] = set()
        for m in re.finditer(BASE["email"], t or ""):
            held[t] |= {f"email:{m.group().lower()}", "domain:" + m.group().lower().rsplit("@")[-1]}
        for m in re.finditer(BASE["ip"], t or ""):
            held[t] |= {f"ip:{m.group()}", "network:" + ".".join(m.group().split(".")[:2])}
    n = len(texts)
    kinds = {}
    for e in set().union(*held.values()):
        of = [t for t in texts if e in held[t]]
        for w in set().union(*(terms[t] for t in of)):
            both, term = sum(w in terms[t] for t in of), sum(w in terms[t] for t in texts)
            value = np.log2(n * both / (term * len(of))) / np.log2(n / len(of)) * (1 - 2.0**-both)
            if value >= pii.GENERALISE:
                kinds[e, w] = "remove" if value >= pii.REMOVE else "generalise"
    assert any(v == "generalise" for v in kinds.values()) and any(v == "remove" for v in kinds.values())
    for r in pii.find_pii(docs(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        base = [(s["start"], s["end"]) for s in r["base"]]
        want = []
        for m in re.finditer(r"[^\W\d_]+", text or ""):
            found = {kinds[e, m.group().lower()] for e in held[text] if (e, m.group().lower()) in kinds}
            if found and not any(a < m.end() and b > m.start() for a, b in base):
                want.append((m.start(), m.end(), max(found)))
        assert [(s["start"], s["end"], s["kind"]) for s in r["added"]] == want


def test_pii_texts_carry_their_own_terms_only(spark, monkeypatch):
    """Texts of one domain with terms of their own: none carries the others'."""
    seen, places = [], pii._places
    monkeypatch.setattr(pii, "_places", lambda texts: seen.extend(texts.collect()) or places(texts))
    rows = [(i, f"x{i} " + " ".join(f"{chr(97 + i // 3)}{chr(97 + k)}term" for k in range(20)) + f" u{i}@example.com") for i in range(30)]
    rows += [(100 + i, f"the other {i}") for i in range(300)]
    found = {r["doc_id"]: r["added"] for r in pii.find_pii(docs(spark, rows)).collect()}
    assert all(len(found[i]) == 20 for i in range(30)) and not any(found[i] for i in range(100, 400))
    assert len(seen) == 30 and all(set(r["terms"]) <= set(r["text"].split()) for r in seen)


def test_few_wide_rows_are_not_broadcast(spark):
    wide = spark.range(30).select("id", F.create_map(F.lit("a"), F.repeat(F.lit("x"), 1 << 20)).alias("m"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert not hinted(scratch.few(wide, "wide"))
    assert hinted(scratch.few(wide.limit(3), "wide")) and hinted(scratch.few(spark.range(10), "long"))


def test_pii_empty(spark):
    assert pii.find_pii(docs(spark, [(1, "x")]).where("false")).count() == 0


# 2


def test_language_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn_from(table)
    found = language_id.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    edges = docs(spark, [(1, None), (2, ""), (3, "123 !? 456"), (4, "the " * 300_000), (None, "thing and the")])
    got = {r["doc_id"]: r for r in language_id.identify(edges, model).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and got[None]["held_out"] is False and 0 <= got[None]["score"] <= 1
    assert language_id.identify(edges.where("false"), model).count() == 0


def test_language_ties_and_repeats(spark):
    rows = [(i, "same words here") for i in range(20)] + [(3, "same words here")] * 2
    table = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "bb").otherwise("aa"))
    flat = language_id.Model(["aa", "bb"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 2), np.float32))
    got = language_id.identify(table, flat).collect()
    assert len(got) == 22 and {(r["lang_pred"], r["score"]) for r in got} == {("aa", 0.5)}


def test_language_learns_every_label(spark):
    rows = [(i, f"{chr(0x4E00 + i // 3)}{chr(0x5E00 + i // 3)} " * 8) for i in range(3 * 300)]
    table = docs(spark, rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") / 3).cast("int").cast("string")))
    assert len(language_id.learn(table.select("lang", "text", F.col("doc_id").alias("key"))).languages) == 300


def test_language_by_brute_force():
    """Weights and scores against a plain dictionary version of the same formulas."""
    rnd = random.Random(4)
    texts = [("ab" if k % 2 else "cd") + " " + " ".join(rnd.choice(["abba", "baba"] if k % 2 else ["cddc", "dccd"]) for _ in range(6)) for k in range(40)]
    rows = [(np.flatnonzero(c), c[np.flatnonzero(c)], k % 2) for k, c in enumerate(map(language_id.gram_counts, texts))]
    model = language_id.Model(["even", "odd"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 2), np.float32))
    language_id.fit_weights(model, rows)
    z, n = {}, {}

    def weight(i, k):
        v = z.get((i, k), 0.0)
        if abs(v) <= language_id.L1:
            return 0.0
        return -(v - np.sign(v) * language_id.L1) / ((language_id.BETA + np.sqrt(n.get((i, k), 0.0))) / language_id.ALPHA + language_id.L2)

    random_ = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for r in random_.permutation(len(rows)):
            index, counts, label = rows[r]
            x = 1 + np.log(counts)
            x = x / np.sqrt((x * x).sum())
            w = {(i, k): weight(i, k) for i in index for k in (0, 1)}
            logits = [sum(v * w[i, k] for v, i in zip(x, index, strict=True)) for k in (0, 1)]
            p = np.exp(np.array(logits) - max(logits))
            p /= p.sum()
            for v, i in zip(x, index, strict=True):
                for k in (0, 1):
                    g = v * (p[k] - (k == label))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / language_id.ALPHA * w[i, k]
                    n[i, k] = old + g * g
    assert all(abs(model.weights[i, k] - weight(i, k)) < 1e-5 for i, k in z)
    assert [model.predict(t)[0] for t in texts] == ["odd" if k % 2 else "even" for k in range(40)]


def test_language_learns_only_from_the_rest(spark):
    import zlib

    rows = [(i, "alpha beta gamma" if zlib.crc32(str(i).encode()) % 3 != 1 else "delta epsilon") for i in range(60)]
    table = docs(spark, rows).withColumn("lang", F.when(F.col("text").startswith("delta"), "held").otherwise("seen"))
    assert language_id.learn_from(table).languages == ["seen"]
    none = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(table, language_id.learn_from(none)).collect()} == {"und"}


# 3


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT-text"]
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "released, UNDER the mit license"), (3, mit.replace("charge", "cost")), (4, None), (5, ""), (6, "word"), (7, "Released under"), (8, "x " * 50000), (2, "released, UNDER the mit license")]
    found = Counter((r["doc_id"], tuple(r["licenses"])) for r in license_scan.license_of(docs(spark, rows)).collect())
    assert found == {(1, ("MIT",)): 1, (2, ("MIT",)): 2, (3, ("MIT-text",)): 1}
    two = docs(spark, [(1, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nx"), (1, "Licensed under CC BY-NC 4.0.")])
    assert sorted((r["licenses"], r["n_lines"]) for r in license_scan.license_of(two).collect()) == [(["CC-BY-NC-4.0"], 1), (["CC-BY-NC-4.0", "MIT"], 2)]
    assert license_scan.license_of(docs(spark, rows).where("false")).count() == 0


def test_license_scan_over_lines(spark):
    """Wrapped, commented and re-flowed notices, and notices beside other words."""
    import textwrap

    rows, want = [], {}
    for k, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        for w, width in enumerate((30, 72, 100, 10_000)):
            wrapped = "\n".join(f"{'# ' if w % 2 else ''}{line}" for line in textwrap.wrap(text, width))
            rows.append((100 * k + w, f"First a line of code.\n{wrapped}\nAnd then more of it, at some length.\n" * (1 + (k == 3))))
            want[100 * k + w] = [name]
    rows += [(9000, "Released under the MIT License, see the file named COPYING."), (9001, "a word " * 20_000 + "\nReleased under the\nMIT License.\n" + "b word " * 20_000), (9002, "The software license of this work is not stated."), (9003, None)]
    want |= {9000: ["MIT"], 9001: ["MIT"]}
    got = {r["doc_id"]: r["licenses"] for r in license_scan.license_of(docs(spark, rows)).collect()}
    assert got == want


def test_license_ties_name_the_first(spark):
    two = {"b": "alpha beta gamma delta epsilon one", "a": "alpha beta gamma delta epsilon two"}
    found = license_scan.license_of(docs(spark, [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon one")]), two).collect()
    assert sorted((r["doc_id"], r["licenses"]) for r in found) == [(1, ["a"]), (1, ["a"]), (2, ["b"])]


# 4


def test_line_dedup_edges(spark):
    rows = [(i, f"menu\n  menu  \n\nown line {i}", "a") for i in range(6)] + [(9, "menu", None), (10, None, "a"), (11, "", "a"), (12, "menu\nonly", "b"), (13, "menu", "a")]
    pages = docs(spark, rows)
    for bound in (line_dedup.BROADCAST_LINES, -1):
        keep, line_dedup.BROADCAST_LINES = line_dedup.BROADCAST_LINES, bound
        try:
            got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(pages, F.col("source")).collect()}
        finally:
            line_dedup.BROADCAST_LINES = keep
        assert got[0]["text"] == "\nown line 0" and got[0]["dropped_lines"] == 2
        assert got[9]["text"] == "menu" and got[10]["text"] is None and got[11]["text"] == "" and got[12]["text"] == "menu\nonly"
        assert (got[13]["text"], got[13]["dropped_lines"]) == ("", 1) and len(got) == len(rows)
        assert got[0]["Fingerprint"] == "mine"
    assert line_dedup.drop_boilerplate(pages.where("false"), F.col("source")).count() == 0


def test_line_dedup_in_a_large_host(spark):
    """A line on a few percent of a host goes, chance repeats and short lines stay."""
    long = "word " * 40_000
    rows = [(i, f"own line number {i}" + ("\nsubscribe to our letter" if i % 33 == 0 else "") + ("\nseen by mere chance" if i % 100 == 0 else "") + ("\nOK." if i % 20 == 0 else ""), "hot") for i in range(2000)]
    rows += [(5000, f"{long}\nsubscribe to our letter\n{long}", "hot"), (5001, "subscribe to our letter", "other"), (5001, "subscribe to our letter", "other")]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs(spark, rows), F.col("source")).collect()}
    assert got[0]["text"] == "own line number 0\nseen by mere chance\nOK." and got[33]["text"] == "own line number 33"
    assert got[5000]["text"] == f"{long}\n{long}" and got[5001]["text"] == "subscribe to our letter"
    assert sum(r["dropped_lines"] for r in got.values()) == 61 + 1


# 5


def test_url_rules_edges(spark):
    urls = [None, "no host", "HTTP://A.Example.COM/en/7x?q#f", "x://example.net/de/81", "x://example.net/de/7", "x://netx/de/", "x://org/es/", "x://b.org", "x://", "a://b://c/d", "x://com?y=/en/", "x://COM/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "x://org/es/")], "page_id long, url string").withColumn("HOST", F.lit(1))
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(pages, labels).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3] == ("example.net", "/de/81", "example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5][2:] == (None, "allow") and got[6][2:] == got[None][2:] == ("org/es/", "block")
    assert got[9][:2] == ("b:", "//c/d") and got[10][:2] == ("com", "") and got[11] == ("com", "/en/", "com/en/", "block")


def test_url_rules_are_mined(spark):
    bad = [(i, f"http://www.pills{i % 2}.info/shop/{i}?ref=x") for i in range(30)]
    good = [(100 + i, f"http://news.info/read/{i}?ref=x") for i in range(60)]
    other = [(500, "http://mail.else.info/shop/a9"), (501, "http://news.info/read/99")]
    pages = spark.createDataFrame(bad + good + other, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in bad + good], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    assert got[500] == "block" and got[501] == "allow" and all(got[i] == "block" for i, _ in bad) and all(got[i] == "allow" for i, _ in good)


def test_url_rules_of_any_length(spark, duck):
    """Only four tokens together condemn a page; many tokens say the same."""
    import itertools

    urls = ["x://site/" + "/".join(p for p, on in zip("abcd", bits, strict=True) if on) for bits in itertools.product([0, 1], repeat=4) for _ in range(12)]
    wide = ["x://wide/" + "/".join(f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))] * 30
    pages = spark.createDataFrame(list(enumerate(urls + wide + ["x://wide/taa", "x://other/d/c/b/a", "x://site/a/b/c/d", "x://site/a/b/c/d"])), "page_id long, url string")
    labels = spark.createDataFrame([(i, u.endswith("a/b/c/d") or "wide" in u) for i, u in enumerate(urls + wide)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    n = len(urls) + len(wide)
    assert all((got[i] == "block") == (u.endswith("a/b/c/d") or "wide" in u) for i, u in enumerate(urls + wide))
    assert [got[n + k] for k in range(4)] == ["block", "block", "block", "block"]
    none = pages.where("false")
    assert url_rules.judge(none, labels).count() == 0 and url_rules.judge(pages.unionByName(pages), labels).count() == 2 * (n + 4)


def test_url_rules_fire(spark, sf_dir):
    found = queries.url_rules_mined(spark, "/root/testdata/sf0.01").where("rule is null").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in found} == {"allow", "block"}


# 6


def test_ann_recall_and_edges(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 16))
    x = (centres[rnd.integers(0, 20, 6000)] + 0.3 * rnd.normal(size=(6000, 16))).astype(np.float32)
    x[1000:3000] = x[1000]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000, None), (7100, [0.0] * 16), (7200, [float("nan")] * 16), (7300, [1.0] * 15 + [None]), (None, [1.0] * 16), (7400, [1.0] * 3)]
    table = ann_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in ann_search.nearest(table, table.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    y, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 6000, 100))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(6000), d))[:10]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 10 and q not in [v for v, _ in found]
        assert all(abs(s - d[v]) < 1e-9 for v, s in found) and [s for _, s in found] == sorted(s for _, s in found)
    assert hits >= 0.95 * 10 * len(got)
    assert [v for v, _ in got[1500]] == list(range(1000, 1010))
    few = table.where("vec_id < 4")
    assert ann_search.nearest(few, few.where("vec_id = 0")).count() == 3
    assert ann_search.nearest(few.where("false"), few.where("false")).count() == 0


def test_ann_rows_and_lengths(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.5]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (200, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 4.0]), (9, [5.0])]
    table = ann_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ROW", F.lit(1)))
    got = sorted(tuple(r) for r in ann_search.nearest(table, table.where("vec_id % 100 = 0")).collect())
    assert got == [(100, 1, 7, 0.0), (100, 1, 7, 0.5), (100, 2, 7, 0.0), (100, 2, 7, 0.5), (100, 3, 100, 0.5), (100, 3, 100, 0.5), (200, 1, 8, 1.0)]


def test_ann_recall_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {}
    for r in queries.op6_ann_search(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(got & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(found)


def test_ann_fits_in_strips():
    import tracemalloc

    x = np.random.default_rng(3).normal(size=(8192, 64))
    tracemalloc.start()
    centroids = ann_search.balanced_centroids(x, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(centroids) >= 1000 and peak < 100e6


# 7


def test_decontamination_edges(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:14])), (2, "Short ITEM here"), (3, None), (4, "..."), (None, "x y z"), (1, "other text"), (5, " ".join(words[:14])), (6, "solo")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(0))
    rows = [(1, "a " + ", ".join(words[1:12]) + " b"), (2, "the short-item HERE!"), (3, None), (4, ""), (5, "nothing to see"), (6, " ".join(words[:9])), (7, "pre " + " ".join(words[:14]) + " mid " + " ".join(words[:10])), (8, "solo other text solo"), (8, "solo other text solo"), (9, "é1 " * 30000)]
    found = decontaminate.decontaminate(docs(spark, rows), bench).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in found}
    assert len(found) == len(rows)
    assert got[1] == (13, 11, ["1", "5"], [(1, 12)])
    assert got[2] == (4, 3, ["2"], [(1, 4)])
    assert got[3] == got[4] == (0, 0, [], []) and got[5][1] == got[6][1] == got[9][1] == 0
    assert got[7] == (26, 24, ["1", "5"], [(1, 15), (16, 26)])
    assert got[8] == (4, 4, ["1", "6"], [(0, 4)])
    left = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6, 9] and "Fingerprint" in left.columns
    assert decontaminate.decontaminate(docs(spark, rows).where("false"), bench).count() == 0
    assert decontaminate.decontaminate(docs(spark, rows), bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_by_brute_force(spark):
    """Random texts over few words, joined with and without broadcasts."""
    rnd = random.Random(6)
    make = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i if i else None, make(rnd.choice([3, 9, 10, 11, 14, 30, 40]))) for i in range(12)] + [(50, "a " * 30)]
    rows = [(i, make(rnd.choice([0, 4, 9, 10, 60, 200]))) for i in range(40)] + [(90, "a " * 300), (91, "b " + "a " * 10)]
    want = {}
    for i, text in rows:
        words, hit, ids = text.split(), set(), set()
        for item, other in items:
            theirs = other.split()
            n = min(10, len(theirs))
            windows = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= {str(item)} if item is not None else set()
        want[i] = (len(words), len(hit), sorted(ids))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontaminate.BROADCAST_WINDOWS, -1):
        was, decontaminate.BROADCAST_WINDOWS = decontaminate.BROADCAST_WINDOWS, bound
        try:
            found = decontaminate.decontaminate(docs(spark, rows), bench).collect()
            assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found} == want
        finally:
            decontaminate.BROADCAST_WINDOWS = was


def test_winnowing_keeps_few_fingerprints(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    table = decontaminate._hashed(docs(spark, [(1, text)]), "text")
    places = table.select(F.col("_places").alias("p"), "_grams").first()
    grams = places["_grams"]
    want = sorted({max(range(j, j + 6), key=lambda i: (-grams[i], i)) for j in range(len(grams) - 5)})
    assert places["p"] == want and len(want) < 0.33 * len(grams)


# 8


def test_best_fit_is_best_fit():
    rnd = random.Random(3)
    for _ in range(150):
        length = rnd.randint(1, 40)
        sizes = [rnd.randint(1, length) for _ in range(rnd.randint(0, 60))]
        rows = token_pack.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        bins = []
        for n in sorted(sizes, reverse=True):
            fitting = [b for b in bins if b[0] >= n]
            if fitting:
                min(fitting)[0] -= n
            else:
                bins.append([length - n])
        assert sorted(b[0] for b in bins) == sorted(length - sum(sizes[i] for i in r) for r in rows)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tiktoken_encoding():
    import tiktoken

    path, pattern = vocabulary()
    with open(path, "rb") as file:
        return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(file.read()), special_tokens={})


def test_packing_is_lossless(spark, tmp_path):
    rows = [(1, "hello world " * 900), (2, None), (3, ""), (None, "no id"), (4, "short"), (4, "short"), (5, "é🙂" * 50)]
    path, pattern = vocabulary()
    packed = token_pack.pack(docs(spark, rows), path, pattern, 256)
    got, found = {}, packed.collect()
    for r in found:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 256 and r["cumulative_lengths"][-1] == r["n_tokens"] and r["position_resets"] == r["cumulative_lengths"][:-1]
        assert not ids[r["n_tokens"] :].any()
        for k, (doc, offset) in enumerate(zip(r["doc_ids"], r["doc_offsets"], strict=True)):
            a, b = r["cumulative_lengths"][k : k + 2]
            got.setdefault((doc, offset), []).append(ids[a:b].tolist())
    encoding = tiktoken_encoding()
    for doc, text in rows:
        whole, offset = [], 0
        while (doc, offset) in got:
            piece = got[doc, offset][0]
            whole, offset = whole + piece, offset + len(piece)
        assert whole == [*encoding.encode_ordinary(text or ""), encoding.n_vocab]
    assert len(got[4, 0]) == 2
    written = token_pack.write_binary(packed, f"file://{tmp_path}/bin").collect()
    data = b"".join((tmp_path / "bin" / r["file"].rsplit("/", 1)[1]).read_bytes() for r in sorted(written))
    assert len(data) == 2 * 256 * len(found) == 2 * 256 * sum(r["rows"] for r in written)


# 9


BPE_EDGES = [
    None, "", " ", "  ", "   a   b ", "a", "\n\n a  b \t c\x1c d", "a" * 520, "I'll don't 've 123 ½ ² x²y", "x" * 3000, "日本語テキスト " * 20, "ababab" * 200,
    " a b  c", "a\u00a0b\u3000c", "🙂🙂 é́ ", "w" * 700 + " " + "hello" * 300, "nul\0in here", "<|endoftext|> 50256",
    "".join(random.Random(1).choice("etaoinshr") for _ in range(900)),
]


def test_bpe_equals_tiktoken(spark):
    path, pattern = vocabulary()
    encoding = tiktoken_encoding()
    rows = list(enumerate(BPE_EDGES)) + [(1, ""), (None, "again again")]
    got = byte_bpe.encode_decode(docs(spark, rows), path, pattern).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert byte_bpe.encode_decode(docs(spark, rows).where("false"), path, pattern).count() == 0


def test_packing_edges(spark):
    path, pattern = vocabulary()
    assert token_pack.pack(docs(spark, [(1, "x")]).where("false"), path, pattern, 64).count() == 0
    long = docs(spark, [(1, "word " * 50_000), (1, "word " * 50_000), (2, None)])
    found = token_pack.pack(long, path, pattern, 1000).collect()
    sizes = Counter()
    for r in found:
        assert r["n_tokens"] <= 1000
        for doc, a, b in zip(r["doc_ids"], r["cumulative_lengths"][:-1], r["cumulative_lengths"][1:], strict=True):
            sizes[doc] += b - a
    n = len(tiktoken_encoding().encode_ordinary("word " * 50_000)) + 1
    assert sizes == {1: 2 * n, 2: 1}


def test_bpe_forgets_words_and_keeps_texts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    path, pattern = vocabulary()
    with open(path, "rb") as file:
        encoder = byte_bpe.Encoder(file.read(), pattern)
    texts = ["Zxqvwords met again, zxqvwords!", "  \xa0Zxqvwords\n met\0 ", " zxqvwords", "", " ", "a  b\n c", "zxqvwords, met. again"]
    for part in (texts, texts[::-1], texts[:2], texts):
        for text, (ids, raw) in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == tiktoken_encoding().encode_ordinary(text) and raw == text.encode()


def test_bpe_of_long_pieces():
    path, pattern = vocabulary()
    with open(path, "rb") as file:
        made = byte_bpe.Encoder(file.read(), pattern)
    encoding, rnd = tiktoken_encoding(), random.Random(5)
    letters = lambda n: "".join(rnd.choice("etaoinshrdlucmfwyp") for _ in range(n))
    texts = [letters(100_000), letters(1_000_000), "-" * 100_003, "ab" * 30_001, " " * 5000 + "x", "日本語" * 3000, "a" * 97, letters(97), letters(96), " ".join(letters(255) for _ in range(400))]
    for text, (ids, raw) in zip(texts, made.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == encoding.encode_ordinary(text) and raw == text.encode()


def test_bpe_of_a_large_vocabulary():
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for i in range(70_000):  # pairs of letters and pairs of those, with ids beyond 16 bits
        token = bytes([97 + i % 26, 97 + i // 26 % 26, 97 + i // 676 % 26, 97 + i // 17576 % 26])
        for part in (token[:2], token[2:], token):
            ranks.setdefault(part, len(ranks))
    content = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    encoding = tiktoken.Encoding("t", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    text = " ".join("".join(random.Random(i).choice("abcdexyz") for _ in range(3 + i % 40)) for i in range(500))
    ids, raw = byte_bpe.Encoder(content, r"\w+|\W+").encode([text])[0]
    assert max(ranks.values()) > 1 << 16 and np.frombuffer(ids, np.int32).tolist() == encoding.encode_ordinary(text) and raw == text.encode()


def test_sessions_batch_size_is_set_once(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "77")
        simhash_dedup.simhash_components(docs(spark, [(1, "a b c d")])).count()
        assert spark.conf.get(setting) == "77"
    finally:
        spark.conf.set(setting, before)


def test_bpe_on_documents(spark, sf_dir):
    encoding = tiktoken_encoding()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, sf_dir).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# 10


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least node reachable by links of two bits or fewer, of distinct values."""
    values = np.array(sorted(prints), np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return {int(values[i]): int(values[find(i)]) for i in range(len(values))}


def test_fingerprints():
    for text in [None, "", "  \n", "One", "one two", "A b C", "É é x y É é x", "a\u00a0b c d e", "t " * 5000, "w1 w2 w3 " * 400_000]:
        assert simhash_dedup.fingerprint_of(None if text is None else text.encode()) == (brute_print(text) if text is None or len(text) < 100_000 else simhash_dedup.fingerprint_of(text.encode()))
    assert brute_print("w1 w2 w3 " * 2000) == simhash_dedup.fingerprint_of(("w1 w2 w3 " * 2000).encode())


def test_links_lose_nothing(spark):
    rnd = random.Random(8)
    values = {0, 2**64 - 1}
    for _ in range(30):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 5, 150])):
            value = centre
            for _ in range(rnd.randint(0, 6)):
                value ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(8)])
            values.add(value)
    want = brute_components(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash_dedup.near_links(table)
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 or bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 2 for r in links.collect())
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    groups = {}
    for v, r in want.items():
        groups.setdefault(r, set()).add(signed(v))
    found = {}
    for v, r in got.items():
        found.setdefault(r, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components.connected_components(chain.where("false")).count() == 0


def test_simhash_edges_and_one_row_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text), (3, text), (7, text + " tail"), (1, None), (2, ""), (None, "  "), (None, "lonely words here now"), (9, "other words of another kind")]
    table = docs(spark, rows)
    got = simhash_dedup.simhash_components(table).collect()
    assert len(got) == len(rows)
    prints = {brute_print(t) for _, t in rows}
    roots = brute_components(prints)
    least = {}
    for i, t in rows:
        r = roots[brute_print(t)]
        least[r] = min(x for x in (least.get(r), i) if x is not None) if i is not None or least.get(r) is not None else None
    want = Counter((i, f"{brute_print(t):016x}", least[roots[brute_print(t)]]) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    kept = simhash_dedup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({v: 1 for v in least.values()})
    assert simhash_dedup.drop_near_duplicates(table.where("false")).count() == 0
    assert simhash_dedup.simhash_components(table.where("false")).count() == 0


def test_simhash_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in rows}
    roots = brute_components(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    got = {tuple(r) for r in queries.op10_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {(i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}
