import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import nndescent, queries, substring, warc

import plain


def test_substrings_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring(spark, sf).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, plain.kept_words([(r.doc_id, r.text) for r in rows]), strict=True)}


@pytest.mark.parametrize("shard", [1_000, 2])
def test_substrings_edges(spark, shard):
    rng = random.Random(4)
    passage = plain.prose(80, 1)
    texts = [(i, plain.prose(rng.randrange(0, 90), i) + " " + passage + "\t" + plain.prose(rng.randrange(0, 90), i + 500)) for i in range(10, 22)]
    texts += [(1, None), (2, ""), (3, plain.prose(49, 2)), (4, plain.prose(49, 2)), (5, plain.prose(50, 3)), (6, plain.prose(50, 3)), (6, plain.prose(50, 3)), (7, "la " * 300), (8, "la " * 120), (30, plain.prose(20_000, 9)), (31, " ".join(plain.prose(20_000, 9).split()[7_000:7_400]))]
    words = passage.split()
    for i in range(40, 46):
        edited = list(words)
        edited[rng.randrange(80)] = "edit"
        texts.append((i, " ".join(edited)))
    texts.append((15, passage))
    frame = plain.docs(spark, texts).withColumn("fp", F.lit("clash")).withColumn("s", F.lit(0))
    got = sorted(tuple(r) for r in substring.digests(frame, shard=shard).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(texts, plain.kept_words(texts), strict=True))
    assert substring.digests(frame.limit(0)).count() == 0


def test_null_keys_come_last(spark):
    text = plain.prose(60, 1)
    got = {r.doc_id: r.n_removed for r in substring.digests(plain.docs(spark, [(None, text), (5, text)])).collect()}
    assert got == {5: 0, None: 60}


def test_automaton_statistics_match_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        asked = [rng.randrange(3) for _ in range(40)]
        automaton = substring.Automaton()
        for r in refs:
            automaton.add(r)
        held = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max((n for n in range(e + 1) if n == 0 or tuple(asked[e - n : e]) in held), default=0) for e in range(1, 41)]
        assert list(automaton.statistics(asked)) == want


def _vectors(seed=0, dim=24):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(150)]
    for _ in range(25):
        rows.append(rows[rng.integers(150)] + 0.05 * rng.standard_normal(dim))
    centre = 3 * rng.standard_normal(dim)
    rows += [centre + 0.2 * rng.standard_normal(dim) for _ in range(60)]
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


def test_embedding_links_match_brute_force(spark):
    rows = _vectors()
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] + [1.0] * 23), (304, [None] + [1.0] * 23), (305, [float("inf")] * 24), (306, rows[3][1]), (307, rows[3][1]), (308, [2 * x for x in rows[4][1]]), (309, [1e300] * 24), (310, [1e-300] * 24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("cid", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(frame).collect()}
    want = {i: (n, c, c == i) for (i, _), (n, c) in zip(rows, plain.cosine_links(rows), strict=True)}
    for i in (309, 310):  # the plain reading overflows here
        want[i] = (1, 309, i == 309)
    assert sum(got[i] != w for i, w in want.items()) <= 2
    true, found = sum(w[0] for w in want.values()), sum(min(got[i][0], w[0]) for i, w in want.items())
    assert found / true > 0.98 and all(got[i][0] <= w[0] for i, w in want.items())


def test_links_between_full_lists_are_kept(spark):
    """Two tight clusters of more than K rows whose members also link across."""
    rng = np.random.default_rng(7)
    dim = 64
    u, w = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    centres = u, 0.97 * u + np.sqrt(1 - 0.97**2) * w
    rows = [(i, rng.standard_normal(dim)) for i in range(100)]
    rows += [(100 + i, centres[i % 2] + 0.1 / np.sqrt(dim) * rng.standard_normal(dim)) for i in range(80)]
    rows = [(i, [float(v) for v in r]) for i, r in rows]
    want = {i: (n, c) for (i, _), (n, c) in zip(rows, plain.cosine_links(rows), strict=True)}
    assert want[100] == (79, 100) and want[101] == (79, 100)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(frame).collect()} == want


@pytest.mark.parametrize("leaf", [2, 64])
def test_few_lone_pairs_are_found(spark, monkeypatch, leaf):
    """Pairs just above the threshold in a table with few links, also with a forest too weak for them."""
    monkeypatch.setattr(nndescent, "LEAF", leaf)
    monkeypatch.setattr(nndescent, "TREES", 1)
    monkeypatch.setattr(nndescent, "MORE_TREES", 1, raising=False)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1940, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.standard_normal((60, 48))
    off -= (off * x[:60]).sum(axis=1)[:, None] * x[:60]
    near = 0.953 * x[:60] + np.sqrt(1 - 0.953**2) * off / np.linalg.norm(off, axis=1)[:, None]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate((x, near)))], "vec_id long, embedding array<double>")
    got = nndescent.near_duplicates(frame).where("n_links > 0").collect()
    assert all((r.n_links, r.component_id) == (1, r.vec_id % 1940) for r in got)
    assert len(got) >= 0.97 * 120


def test_embedding_edges(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0]), (None, [1.0, 0.001]), (4, None)], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in nndescent.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), (4, 0, 4)], key=str)
    assert nndescent.near_duplicates(frame.limit(0)).count() == 0


def test_archives_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op10_warc(spark, sf).collect()}
    first = {}
    for p in pages:
        body = (p.html or "").encode()
        first[body] = min(first.get(body, p.page_id), p.page_id)
    for p in pages:
        body, r = (p.html or "").encode(), got[p.page_id]
        own = first[body] == p.page_id
        assert tuple(r) == (p.page_id, len(body), warc.digest(body), "response" if own else "revisit", None if own else first[body])


def test_archive_edges(spark, tmp_path):
    rows = [(3, "http://a/\r\nx", "same é"), (1, None, "same é"), (2, "u", None), (4, "u", ""), (None, "u", "nameless"), (5, "u", "x" * 3_000_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "P*M\x18\0\0\0\0"), (7, "u", "P*M\x18\0\0\0\0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("frame", F.lit("clash"))
    warc.write(pages.repartition(3), f"{tmp_path}/a")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.url, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == sorted([(1, "response", None, 7, None, "same é"), (3, "revisit", 1, 7, "http://a/%0D%0Ax", None), (2, "response", None, 0, "u", ""), (4, "revisit", 2, 0, "u", None), (None, "response", None, 8, "u", "nameless"), (5, "response", None, 3_000_000, "u", "x" * 3_000_000), (6, "response", None, 14, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "response", None, 8, "u", "P*M\x18\0\0\0\0"), (7, "response", None, 8, "u", "P*M\x18\0\0\0\0")], key=str)
    warc.write(pages, f"{tmp_path}/b", min_bytes=8)
    assert {r.page_id for r in warc.read(spark, f"{tmp_path}/b").collect() if r.record_type == "revisit"} == set()
    warc.write(pages.limit(0), f"{tmp_path}/c")
    assert warc.read(spark, f"{tmp_path}/c").count() == 0


def test_archives_start_with_their_dictionary():
    records = [warc.record(i, "u", f"<p>{plain.prose(100, i)}</p>".encode(), None, False) for i in range(60)]
    parts = list(warc.frames(iter(records)))
    assert parts[0][:4] == warc.DICT_MAGIC and len(parts) == 61
    sep = warc.SEPARATOR.encode()
    rows = list(warc.parse(b"".join(p + sep for p in parts)))
    assert [r[0] for r in rows] == list(range(60)) and rows[5][-1] == f"<p>{plain.prose(100, 5)}</p>".encode()
    import zstandard

    plain_size = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert sum(map(len, parts[1:])) < plain_size
    damaged = parts[:1] + [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(parts[0][8:])).compress(records[0].replace(b"<p>", b"<q>"))]
    with pytest.raises(ValueError):
        list(warc.parse(b"".join(damaged)))
