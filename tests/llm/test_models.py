import numpy as np
from pyspark.sql import functions as F

from logwarden.llm import langid, quality, queries, toxicity

import plain


def test_language_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_language(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    words = {"aa": "the of and with", "bb": "der die und nicht", None: "none"}
    rows = [(i, f"{words[k]} {words[k].split()[i % 4] if k else ''} {i}", k) for i, k in enumerate(["aa", "bb", "aa", "bb", None, "aa", "bb"])]
    rows += [(20, None, "aa"), (21, "12 34 !?", "bb"), (22, "", "aa"), (None, "the und", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(docs)
    more = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "of the and with " * 50_000), (5, "nicht und der"), (5, "nicht und der"), (6, "ß")], "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(more, model).collect())
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb"), (5, "bb")] and got[6][1] in ("aa", "bb")
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(more, nothing).collect()} == {"und"}
    assert langid.predict(more.limit(0), model).count() == 0


def test_repeats_do_not_fill_the_language_sample(spark):
    rows = [(1, "the of and with", "aa")] * 60 + [(1, "AND the", "aa"), (1, None, "aa"), (1, "", "aa")] + [(i, f"der die und nicht {i}", "bb") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    whole = langid.fit
    try:
        langid.fit = lambda names, langs, bits, *rest: seen.append(langs) or whole(names, langs, bits, *rest)
        model = langid.train(docs, sample=4)
    finally:
        langid.fit = whole
    assert sorted(seen[0]) == ["aa"] + ["bb"] * 4
    again = langid.train(docs.orderBy(F.rand(3)), sample=4)
    assert (model.weights == again.weights).all() and model.names == again.names


def test_quality_training_does_not_depend_on_the_order_of_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    twice = docs.unionByName(docs.limit(5))
    a, b = quality.train(twice, labels), quality.train(twice.orderBy(F.rand(5)).repartition(7), labels)
    assert a.rules and (a.rules, a.linear) == (b.rules, b.linear)


def test_folded_scores_are_kernel_ridge_scores():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd" if i % 2 else "cdef"), 40)) for i in range(30)]
    bits = []
    for t in texts:
        row = np.zeros(langid.CELLS, bool)
        langid.presence(t, row)
        bits.append(np.packbits(row).tobytes())
    model = langid.fit(["x", "y"], ["xy"[i % 2] for i in range(30)], bits, landmarks=8)
    unit = langid._unit(bits)
    assert (np.argmax(unit @ model.weights + model.bias, axis=1) == np.arange(30) % 2).all()
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    want = len(grams[0] & grams[1]) / (len(grams[0]) * len(grams[1])) ** 0.5
    assert abs(float(unit[0] @ unit[1]) - want) < 0.02


def test_quality_held_out(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op2_quality(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert held and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_rules_compile_to_what_they_say(spark):
    rules = quality.Rules(0.5, [(1.5, ((1, True, 1.0), (12, False, 0.6))), (-2.0, ((0, False, 2.0),))], [(0.25, 2, 1.0, 4.0)])
    texts = [None, "", "one", "a a a a b b", "different words stand here alone", "x " * 100_000]
    frame = plain.docs(spark, [(i, t) for i, t in enumerate(texts)]).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.score for r in quality.score(frame, rules).collect()}
    for i, t in enumerate(texts):
        s = quality.statistics(t)
        z = 0.5 + 1.5 * (s[1] > 1.0 and s[12] <= 0.6) - 2.0 * (s[0] <= 2.0) + 0.25 * max(1.0, min(4.0, s[2]))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert quality.keep_good(frame, rules).columns == frame.columns


def test_quality_edges(spark):
    docs = plain.docs(spark, [(1, "fine text here"), (2, None), (2, None), (3, "")])
    none = spark.createDataFrame([(9, 1, 0), (None, 1, 0), (1, None, None), (2, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, none.limit(0)):
        scores = [r.score for r in quality.score(docs, quality.train(docs, labels)).collect()]
        assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
        scores = [r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
        assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert quality.score(docs.limit(0), quality.Rules(0.0, [], [])).count() == 0


def _small_index(rng, n=300, terms=12):
    counts = [{int(i): int(rng.integers(1, 4)) for i in rng.choice(terms, rng.integers(1, 5), replace=False)} for _ in range(n)]
    index = toxicity.Index({f"t{i}": i for i in range(terms)}, rng.random(terms) + 1, list(range(n)), rng.integers(0, 2, n).astype(float), np.ones(n), [], 0.1)
    index.vectors = [index.vector(c) for c in counts]
    index.__post_init__()
    return index, counts


def test_block_bounds_lose_no_neighbour():
    index, counts = _small_index(np.random.default_rng(3))
    dense = np.zeros((len(counts), 12))
    for i, (at, w) in enumerate(index.vectors):
        dense[i, at] = w
    for c in counts[:60]:
        at, w = index.vector(c)
        cos = np.round(dense[:, at] @ w, 9)
        want = sorted((-float(x), i) for i, x in enumerate(cos) if x > 0)[: toxicity.K]
        got = [(-x, i) for x, i in index.nearest(at, w, toxicity.K)]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([x for x, _ in got], [x for x, _ in want])


def test_isotonic_rises():
    rng = np.random.default_rng(2)
    votes = np.round(rng.random(200), 2)
    x, y = toxicity.isotonic(votes, (rng.random(200) < votes).astype(float), np.ones(200))
    assert list(x) == sorted(x) and list(y) == sorted(y) and 0 < y[0] < y[-1] < 1


def test_toxicity_learns_and_explains(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, plain.prose(60, i) + (" Vile! awful" if bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(1000, plain.prose(50, 7) + " vile awful vile"), (1001, plain.prose(50, 8)), (1002, None), (1003, plain.prose(30_000, 9) + " vile AWFUL"), (1000, plain.prose(50, 7) + " vile awful vile")]
    docs = plain.docs(spark, rows).withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [1, 0, 0, 1]
    assert set(got[1000].matched) == {"vile", "awful"} and got[1000].neighbours[0].id % 4 == 0
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(240)]) > 0.98


def test_toxicity_matches_plain_cosine_votes(spark, sf):
    """Every vote by cosine with every example over all weighted terms, without index or blocks."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.train(docs, labels)
    dense = np.zeros((len(index.ids), len(index.idf)))
    for i, (at, w) in enumerate(index.vectors):
        dense[i, at] = w
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert index.terms and not set(index.terms) - {w for t in texts.values() for w in toxicity.terms_of(t)}
    for r in toxicity.score(docs, index).collect():
        q, vote = np.zeros(len(index.idf)), index.base
        for w in set(toxicity.terms_of(texts[r.doc_id])) & set(index.terms):
            q[index.terms[w]] = (1 + np.log(toxicity.terms_of(texts[r.doc_id]).count(w))) * index.idf[index.terms[w]]
        if q.any():
            cos = np.round(dense @ (q / np.linalg.norm(q)), 9)
            near = sorted((-c, i) for i, c in enumerate(cos) if c > 0)[: toxicity.K]
            if near:
                w = [index.weights[i] / (1 + toxicity.SOFT + c) for c, i in near]
                vote = sum(x * index.labels[i] for x, (_, i) in zip(w, near)) / sum(w)
        assert abs(r.score - float(index.probability(np.round(np.array([vote]), 6))[0])) < 1e-6


def test_toxicity_knows_fixed_phrases_and_wide_vocabularies(spark):
    """A slogan that always stands in the same words, and five thousand insults in many combinations."""
    rng = np.random.default_rng(8)
    insults = [f"slur{i}" for i in range(5_000)]
    rows, labels = [], []
    for i in range(1_200):
        bad = i % 2
        extra = " go home you rotten lot" if bad and i % 4 == 1 else " ".join(["", *rng.choice(insults, 300, replace=False)]) if bad else ""
        rows.append((i, plain.prose(40, i) + extra))
        labels.append((i, 1, bad))
    rows += [(2_000, plain.prose(60, 5) + " go home you rotten lot " + plain.prose(20, 6)), (2_001, plain.prose(60, 7) + " slur7 slur4999 slur250"), (2_002, plain.prose(60, 8))]
    docs = plain.docs(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.train(docs, marks)
    assert {"go", "home", "you", "rotten", "lot"} <= set(index.terms) and len(set(insults) & set(index.terms)) > 4_000
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, index).collect()}
    assert [got[i] for i in (2_000, 2_001, 2_002)] == [1, 1, 0] and np.mean([got[i] == i % 2 for i in range(1_200)]) > 0.98
