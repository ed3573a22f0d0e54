import random

import pytest
from pyspark.sql import functions as F

from logwarden.llm import decontaminate, mixing, pii, queries, simhash
from logwarden.llm.common import stored
from logwarden.llm.forest import components

import plain


def sample(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_fingerprints_and_components_match_brute_force(spark, sf):
    rows = sample(spark, sf)
    got = {r.doc_id: r for r in queries.op3_simhash(spark, sf).collect()}
    fps = [plain.simhash(r.text) for r in rows]
    want = plain.least_reachable([r.doc_id for r in rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {r.doc_id: (f"{f:016x}", w) for r, f, w in zip(rows, fps, want)}


@pytest.mark.parametrize("cell", [512, 3])
def test_links_lose_no_component(spark, cell):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {0, (1 << 64) - 1, 1}
    for b in base:
        x = b
        for _ in range(12):
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            x = rng.choice([x, b])
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    from logwarden.llm.forest import components

    got = {r.node: r.component for r in components(frame.select(F.col("fp").alias("node")), simhash.links(frame, cell=cell)).collect()}
    want = plain.least_reachable(signed, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [got[f] for f in signed] == want


def test_crowded_cells_are_linked_without_the_driver(spark):
    """What Python makes of a few fingerprints, 2,080 points each, must not be taken for small and broadcast."""
    rng = random.Random(7)
    fps = sorted({(rng.getrandbits(31) << 32) | 0x55555555 for _ in range(300)} | {(k ^ (1 << b)) << 32 | 0x55555555 for k in range(9) for b in range(20)})
    frame = stored(spark.createDataFrame([(f,) for f in fps], "fp long"))
    edges = simhash._midpoints(frame)
    got = {r.node: r.component for r in components(frame.select(F.col("fp").alias("node")), edges).collect()}
    want = plain.least_reachable(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [got[f] for f in fps] == want
    assert "Broadcast" not in edges._jdf.queryExecution().toString()


def test_simhash_edges(spark):
    long = plain.prose(30_000, 1)
    frame = plain.docs(spark, [(5, None), (3, ""), (9, "One two"), (9, "One two"), (4, "one TWO"), (None, "one two"), (7, long), (8, long + " tail"), (2, "é è")])
    frame = frame.withColumn("fp", F.lit("clash")).withColumn("cell", F.lit(1))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 4), (9, 4), (4, 4), (None, 4), (7, 7), (8, 7), (2, 2)], key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark, sf):
    rows, items = sample(spark, sf), [(r.item_id, r.text) for r in sample(spark, sf, "benchmark")]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_decontaminate(spark, sf).collect()}
    assert got == {r.doc_id: plain.contamination(r.text, items) for r in rows}
    assert any(g[1] for g in got.values())


def test_decontamination_edges(spark):
    passage = plain.prose(40, 3)
    items = [(1, passage), (2, "Short Item"), (10, "x"), (3, None), (4, ""), (1, passage), (None, "naïve É Test"), (7, "a a a a a a a a a a a a a a a")]
    texts = [
        (1, passage), (2, "start " + " ".join(passage.split()[5:18]) + " end"), (3, " ".join(passage.split()[5:17])), (4, "short, ITEM! x"), (5, None), (6, ""), (6, ""),
        (None, passage.upper()), (8, "naïve É test naïve é test"), (9, "a " * 40), (10, plain.prose(2_000, 9) + " " + passage), (11, passage + " " + passage), (12, passage[:-1]),
    ]
    frame = plain.docs(spark, texts).withColumn("item", F.lit("clash")).withColumn("pos", F.lit(3))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = decontaminate.hits(frame, bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *plain.contamination(t, items)) for i, t in texts], key=str)
    assert decontaminate.hits(frame.limit(0), bench).count() == 0
    none = decontaminate.hits(frame, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    clean = decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert {r.doc_id for r in clean.collect()} == {3, 5, 6, 10, 12} - ({10} if plain.contamination(texts[10][1], items)[4] else set()) - ({12} if plain.contamination(texts[12][1], items)[4] else set()) - ({3} if plain.contamination(texts[2][1], items)[4] else set())


def test_proximity_finds_broken_phrases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    frame = plain.docs(spark, [(1, item.replace("beta", "beta extra words")), (2, "alpha " + "x " * 40 + "nu"), (3, "nothing here")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    index = decontaminate.Index(frame, bench)
    assert {r["_id"] for r in index.proximity().collect()} == {1}


def test_personal_data_matches_brute_force(spark, sf):
    rows = sample(spark, sf)
    got = {r.doc_id: r for r in queries.op9_pii(spark, sf).collect()}
    for r in rows:
        want = plain.personal(r.text)
        assert got[r.doc_id].base_sha256 == plain.sha(",".join(f"{k}:{s}:{e}" for k, s, e in want))
        assert [got[r.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got[r.doc_id].spans.split(","))
    assert sum(r.n_email for r in got.values()) > 0


def test_personal_data_edges(spark):
    texts = [
        (1, None), (2, ""), (3, "a@b.co a@b.co+c@d.org x.@y.z %@-.-"), (4, "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3"), (5, "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0"),
        (6, "+1 (456) 555-2186 +12 +49 30 1234567890123 +1-2"), (7, "😀 mail: é@b.co 😀x@y.zz"), (8, "a" * 200_000 + "@" + "b.c" * 30_000 + " " + "7" * 100_000), (9, "a@b" + ".c" * 50_000),
        (10, "IBAN GB82 WEST 1234 5698 7654 32, wrong GB82 WEST 1234 5698 7654 33"), (11, "ssn 123-45-6789 order 123-45-6789"), (11, "ssn 123-45-6789 order 123-45-6789"), (12, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"),
        (13, "- 0 -4 1-1 1..1.1.1.1 1.1.1.1."), (14, "\n+1 222 333 4444\n4111111111111111\n"),
    ]
    frame = plain.docs(spark, texts).withColumn("kind", F.lit("clash"))
    got = pii.find(frame).select("doc_id", pii.joined(F.filter("pii", lambda s: s["ord"] < 4)).alias("base"), pii.joined(F.col("pii")).alias("all")).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: r.doc_id), texts):
        assert (r.doc_id, r.base) == (i, ",".join(f"{k}:{s}:{e}" for k, s, e in plain.personal(t)))
    spans = {r.doc_id: r["all"] for r in got}
    assert spans[10] == "iban:5:32" and spans[11] == "ssn:4:15"
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[7] == "😀 mail: é@b.co 😀<EMAIL>"
    assert clean[1] is None and clean[2] == "" and clean[14] == "\n<PHONE>\n<CARD>\n"
    assert pii.redact(frame).columns == frame.columns
    assert pii.find(frame.limit(0)).count() == 0


def test_mixing_meets_budgets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "big").otherwise(F.col("source")))
    plan = {r.source: r for r in mixing.budgets(docs.select("source", mixing.n_tokens(F.col("text")).alias("n_tokens"))).collect()}
    out = mixing.mix(docs, block_tokens=2_000)
    rows = out.select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank").collect()
    assert abs(sum(p.weight for p in plan.values()) - 1) < 1e-9 and 0 < next(iter(plan.values())).alpha < 1
    for s, p in plan.items():
        own = [r for r in rows if r.source == s]
        got, longest = sum(r.n_tokens for r in own), max(r.n_tokens for r in own)
        assert p.budget - max(longest, max(r.n_tokens or 0 for r in docs.select(mixing.n_tokens(F.col("text")).alias("n_tokens")).collect())) <= got <= p.budget
        assert max(r.epoch for r in own) + 1 <= mixing.REPEATS + 1
        assert len({(r.doc_id, r.epoch) for r in own}) == len(own)
    assert {tuple(r) for r in mixing.mix(docs.repartition(5), block_tokens=2_000).select("doc_id", "source", "n_tokens", "epoch", "block", "block_rank").collect()} == {tuple(r) for r in rows}


def test_mixing_deals_rows_without_id_to_blocks(spark):
    docs = plain.docs(spark, [(None, f"word {i} " * 10) for i in range(300)]).withColumn("source", F.lit("one"))
    got = mixing.mix(docs, block_tokens=500).collect()
    assert len(got) == 300 and len({r.block for r in got}) > 6


def test_mixing_edges(spark):
    frame = spark.createDataFrame([(1, "a b c", None), (2, None, "x"), (3, "", "x"), (4, "a b", "x"), (4, "a b", "x"), (5, "", "empty"), (None, "q", "x")], "doc_id long, text string, source string")
    frame = frame.withColumn("block", F.lit("clash")).withColumn("tokens", F.lit(1))
    rows = mixing.mix(frame, entropy_share=1.0).collect()
    assert {r.source for r in rows} == {None, "x"}
    assert mixing.mix(frame.limit(0)).count() == 0
    one = mixing.mix(frame.where("source = 'x'")).collect()
    assert len(one) == 5
    limited = mixing.budgets(frame.select("source", mixing.n_tokens(F.col("text")).alias("n_tokens")), 1.0, 1.0).collect()
    assert all(r.budget <= r.tokens + 1 for r in limited)
