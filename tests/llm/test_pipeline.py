"""The pipeline's stages, each against what it must keep and drop."""

import corpus_pipeline
from deltaweave.llm import decontaminate, simhash_dedup


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    _, language, lines, near, clean, tokens = seen
    assert language.count() == 200  # every document here has letters of a known language
    assert lines.count() == language.count()
    ids = lambda t: {r["doc_id"] for r in t.select("doc_id").collect()}
    found = simhash_dedup.simhash_components(lines)
    assert ids(near) == {r["component_id"] for r in found.collect()} and near.count() == len(ids(near))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.decontaminate(near, bench).where("n_hit > 0").collect()}
    assert ids(clean) == ids(near) - hit
    assert ids(tokens) == ids(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, tokens.collect()))


def test_stages_take_empty_and_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "The and of the ther in that", "en", None, 5), (1, "The and of the ther in that", "en", None, 5)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0, name
        assert stage(spark, odd, sf_dir).count() <= 4, name


def test_chain_against_other_ways(spark, sf_dir, duck):
    """Every stage on what the last one kept, by SQL, brute force and tiktoken."""
    import hashlib

    from test_operators import tiktoken_encoding
    from test_shingle_dedup import brute_kept

    from deltaweave.llm import queries
    from deltaweave.llm.scratch import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    language, lines, near, clean, tokens = (stage for _, stage in corpus_pipeline.STAGES)
    kept = keep(language(spark, docs, sf_dir), "language")
    assert kept.columns == columns and kept.count() == docs.count()
    kept = keep(lines(spark, kept, sf_dir), "lines")
    want = {r[0]: r[1] for r in duck.execute(f"SELECT doc_id, text FROM ({queries.ORACLE_SQL['op4_line_dedup']})").fetchall()}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == columns and dict(rows) == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect() if r["text"] != docs.where(f"doc_id = {r['doc_id']}").first()["text"])
    kept = keep(near(spark, kept, sf_dir), "near")
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert kept.columns == columns and ids == sorted(brute_kept(rows).elements())
    hit = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op7_benchmark_decontamination']}) WHERE contaminated").fetchall()}
    kept = keep(clean(spark, kept, sf_dir), "clean")
    changed = {i for i, t in rows if t != docs.where(f"doc_id = {i}").first()["text"]}
    assert set(ids) - hit <= {r["doc_id"] for r in kept.collect()} <= set(ids) - (hit - changed)
    encoding, texts = tiktoken_encoding(), dict(rows)
    out = {r["doc_id"]: r for r in tokens(spark, kept, sf_dir).collect()}
    assert set(out) == {r["doc_id"] for r in kept.collect()}
    for i, r in out.items():
        found = encoding.encode_ordinary(texts[i])
        assert r["n_tokens"] == len(found) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, out.values()))


def test_language_stage_drops_what_it_cannot_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "", "en", "a", 0), (10**6 + 2, "12 34 !", "en", "a", 7), (10**6 + 3, "the " * 200_000, "en", "a", 1)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(odd), sf_dir).where("doc_id >= 1000000").collect()}
    assert kept == {10**6 + 3}


def test_heaps_give_back(spark):
    import gc

    from deltaweave.llm.scratch import heaps_give_back

    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    garbage = spark.sparkContext._gateway.new_array(jvm.byte, 200 << 20)
    before = runtime.totalMemory() - runtime.freeMemory()
    del garbage
    gc.collect()
    heaps_give_back(spark)
    assert before - (runtime.totalMemory() - runtime.freeMemory()) > 100 << 20
