"""The near-duplicate stage against brute force over five-word shingles."""

import random
from collections import Counter

import corpus_pipeline
from deltaweave.llm import shingle_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows):
    """The least id of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return Counter(least.values())


def test_stage_drops_every_similar_text(spark):
    rnd = random.Random(3)
    rows = [(10_000, None), (10_001, " "), (10_002, "short text"), (10_003, "Short  text"), (10_004, "short texts")]
    for f in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([8, 60, 300]))]
        for _ in range(rnd.choice([3, 12, 40])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    table = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == brute_kept(rows)


def test_similarity_is_met_exactly(spark):
    words = [f"w{i}" for i in range(13)]  # nine shingles
    rows = [(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, " ".join([*words[:12], "y"])), (4, " ".join(words[:10] + ["z"]))]
    sets = [shingle_dedup.shingles_of(t.encode()) for _, t in rows]
    assert shingle_dedup.similar(sets[0], sets[1]) and shingle_dedup.similar(sets[0], sets[2]) and not shingle_dedup.similar(sets[0], sets[3])


def test_groups_yield_few_pairs(spark, monkeypatch):
    """Variants too far apart, in groups as large as all of them, and texts with one run of words in common."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(120):
        words = list(base)
        for i in rnd.sample(range(150), rnd.choice([1, 3, 7, 9])):
            words[i] = f"x{rnd.randrange(12)}"
        rows.append((len(rows), " ".join(words)))
    for _ in range(40):
        words = [f"y{rnd.randrange(10**6)}" for _ in range(100)]
        rows.append((len(rows), " ".join([*words[:50], "one", "run", "of", "five", "words", *words[50:]])))
    seen, verified = [], shingle_dedup._verified

    def counted(pairs, sets):
        seen.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(shingle_dedup, "_verified", counted)
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, table, "")
    assert Counter(r["doc_id"] for r in kept.collect()) == brute_kept(rows)
    assert len(seen) == 2 and sum(seen) < 4 * len(rows), seen
