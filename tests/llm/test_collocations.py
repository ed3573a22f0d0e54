import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import collocations

import plain


def _mined(rows, min_count, top=2_000):
    """The contract read phrase by phrase, on (text, lang) rows."""
    f, words = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain.LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            words[lang or "und"] += len(w)
            for k in range(1, 5):
                counts.update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def _texts(seed):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "hall", "the", "the", "of", "é", "ÉÉ", "\x1c", "\x85x", "日本", "a", "b"]
    out = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", "\r\n"]) for x in w)
        out.append((text + " new york city hall; of the of the of", ["en", "de", None, "und"][i % 4]))
    return out + [(None, "en"), ("", "fr"), ("...", "es"), ("new york", None), ("the " * 3_000, "en"), ("x" * 50_000, "en")] * 2


@pytest.mark.parametrize("window,hot_share", [(8 << 20, 4096), (200, 40)])
def test_mining_matches_brute_force(spark, monkeypatch, window, hot_share):
    for name, value in (("WINDOW_BYTES", window), ("HOT_SHARE", hot_share)):
        monkeypatch.setattr(collocations, name, value)
    rows = _texts(1)
    docs = spark.createDataFrame([(t, la, 1, "x", "y") for t, la in rows], "text string, lang string, n int, phrase string, prefix string").repartition(3)
    for least in (5, 30):
        got = sorted(tuple(r) for r in collocations.mine(docs, min_count=least).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert got == _mined(rows, least)
    few = sorted(tuple(r) for r in collocations.mine(docs, min_count=5, top=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert few == _mined(rows, 5, 3)


def test_mining_empty(spark):
    docs = plain.docs(spark, [(1, None), (2, ""), (3, " .,")])
    assert collocations.mine(docs).count() == 0 and collocations.mine(docs.limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    big = 9_000_000_000_000_000
    candidates = spark.createDataFrame([("en", "a b", big), ("en", "a b c", big - 1)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", p, big + i) for i, p in enumerate(["a", "b", "c", "a b", "b c"])], "lang string, phrase string, total long")
    got = {r.phrase: tuple(r)[2:] for r in collocations.scores(candidates, totals, 10 * big).collect()}
    count = {p: big + i for i, p in enumerate(["a", "b", "c", "a b", "b c"])}
    assert got["a b"] == (big, count["a"], count["b"], 2_000_000 * big // (count["a"] + count["b"]))
    want = min((2_000_000 * (big - 1) // (count[x] + count[y]), k, count[x], count[y]) for k, (x, y) in enumerate([("a", "b c"), ("a b", "c")]))
    assert got["a b c"] == (big - 1, want[2], want[3], want[0])


def test_windows_repeat_no_phrase():
    rng = random.Random(5)
    text = "".join(rng.choice(["aa ", "b ", "  ", "c", "longer ", ". ", "\n"]) for _ in range(3_000)).encode()
    for k in range(1, 5):
        for size in (1, 7, 64, 10_000):
            got, want = Counter(), Counter()
            for window, _ in collocations.windows([text, b"", text[:50]], k, size):
                for piece in window.split(b"\n"):
                    w = piece.split()
                    got.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            for t in (text, text[:50]):
                for piece in re.split(rb"[.\n]", t):
                    w = piece.split()
                    want.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            assert got == want


def test_bloom_loses_nothing(spark):
    phrases = spark.createDataFrame([("en", f"w{i} w{i * 7}") for i in range(5_000)], "lang string, phrase string")
    bloom = collocations.bloom_filter(phrases)
    first, second = (collocations.word_hashes(f"w{i * m}" for i in range(10_000)) for m in (1, 7))
    h = collocations._chained(collocations._chained(collocations.word_hashes(["en"] * 10_000), first), second)
    known = collocations._known(bloom, h)
    assert known[:5_000].all() and np.mean(known[5_000:]) < 0.05
    assert not collocations.bloom_filter(phrases.where(F.lit(False))).any()
