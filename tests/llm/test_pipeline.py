from functools import partial

from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import mixing, quality, simhash
from logwarden.llm.common import remainder

import plain


def test_every_stage_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(plain.docs(spark, [(None, "a text without an id"), (900_001, None), (900_002, ""), (5, "twice"), (5, "twice")]))
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(remainder("doc_id", 5) != 0)
    step = {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
        if name != "mixing":
            assert rows.columns == docs.columns
        step[name] = rows = spark.createDataFrame(rows.collect(), rows.schema)
    texts = lambda name: sorted(((r.doc_id, r.text) for r in step[name].collect()), key=str)

    rules = quality.train(docs, labels)
    good = {(r.doc_id, r.text) for r in quality.score(docs.withColumn("copy", F.col("text")), rules, "copy").where("predicted = 1").collect()}
    assert {*texts("quality classifier")} == good and list(stages) == list(step)

    seen = sorted({*texts("quality classifier")}, key=str)
    fps = [plain.simhash(t) for _, t in seen]
    least = plain.least_reachable([i for i, _ in seen], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert texts("simhash near-dedup") == sorted(((i, t) for (i, t), c in zip(seen, least) if i == c), key=str)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert texts("benchmark decontamination") == [(i, t) for i, t in texts("simhash near-dedup") if not plain.contamination(t, items)[4]]

    clean = {}
    for i, t in texts("personal data"):
        clean.setdefault(i, []).append(t)
    assert sum(map(len, clean.values())) == len(texts("benchmark decontamination"))
    for i, t in texts("benchmark decontamination"):
        if not plain.personal(t):
            assert t in clean[i] or any("<IBAN>" in x or "<SSN>" in x for x in clean[i])
        else:
            assert t not in clean[i] and any("<" in x for x in clean[i])
        assert not any(k == "email" for x in clean[i] for k, _, _ in plain.personal(x))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in step["personal data"].collect())

    budget = {r.source: r.budget for r in mixing.budgets(step["personal data"].select("source", mixing.n_tokens(F.col("text")).alias("n_tokens"))).collect()}
    drawn = step["mixing"].collect()
    assert drawn and {(r.doc_id, r.text) for r in drawn} <= {*texts("personal data")}
    for s, b in budget.items():
        assert sum(r.n_tokens for r in drawn if r.source == s) <= b


def test_stages_keep_columns_of_any_name(spark, sf):
    names = ["_id", "_th", "pii", "_text", "_stats", "_body", "component", "row", "_key", "_aside0"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.col("doc_id").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, old = stage(spark, docs, sf), docs
        assert docs.columns == old.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() and docs.where(" or ".join(f"not (`{n}` <=> doc_id)" for n in names)).count() == 0
    made = ["n_tokens", "epoch", "block", "block_rank"]
    mixed = corpus_pipeline.mixing_stage(spark, docs.select("*", *[F.lit("clash").alias(n) for n in made]), sf)
    assert mixed.columns == [*docs.columns, *made]
    assert 0 < mixed.count() == mixed.where(F.col("epoch").cast("string") != "clash").count()


def test_stages_accept_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_near_duplicates_in_crowded_cells_bypass_the_driver(spark, sf, monkeypatch):
    made, midpoints = [], simhash._midpoints
    monkeypatch.setattr(simhash, "links", partial(simhash.links, cell=1))
    monkeypatch.setattr(simhash, "_midpoints", lambda fps: made.append(midpoints(fps)) or made[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).select("doc_id").collect())
    rows = docs.collect()
    fps = [plain.simhash(r.text) for r in rows]
    least = plain.least_reachable([r.doc_id for r in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert got == sorted({*least})
    assert made and not any("Broadcast" in e._jdf.queryExecution().toString() for e in made)
