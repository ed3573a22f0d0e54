import itertools
import re

from pyspark.sql import functions as F

from logwarden.llm import filteraudit, linededup

import plain


def _kept_lines(rows, min_chars=20, min_docs=3):
    """(n_lines, n_dropped, kept) per row (id, text), by reading every line of every document."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(plain.LOWER)
    order = lambda i: float("-inf") if i is None else i
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and order(i) < max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark):
    said = "This line is said by everyone here"
    rows = [(i, f"  {said.upper()}\t\nown line number {i:020d}\n{said}") for i in range(1, 40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, said), (None, f"{said}\nand more of it"), (7, f"repeated id\n{said}"), (7, f"repeated id\n{said}")]
    rows += [(60 + i, f"exactly twenty chars\nnineteen characters\nÄÖÜ É short ümläut lîne{' ' * i}\r\n\x0bEXACTLY TWENTY CHARS") for i in range(3)]
    rows += [(70, f"only two hold this line of text\n{said}"), (71, "ONLY two hold this line of text"), (71, "only two hold this line of text")]
    rows += [(80, "\n".join(f"line {i % 30_000} of a very long text" for i in range(60_000))), (81, "\n".join(f"line {i} of a very long text" for i in range(0, 60_000, 3))), (82, "\n".join(f"LINE {i} of a very long text" for i in range(0, 60_000, 2)))]
    docs = plain.docs(spark, rows).select("*", F.lit(1).alias("_id"), F.lit("x").alias("kept"), F.lit(2).alias("row"), F.lit(3).alias("h"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.deduplicate(docs).collect()), key=str)
    assert got == _kept_lines(rows)
    whole = linededup.drop_lines(docs)
    assert whole.columns == docs.columns
    kept = {(i, t) for i, _, _, t in got}
    assert all(r.text is None and r.doc_id == 50 or (r.doc_id, r.text) in kept for r in whole.collect()) and whole.count() == len(rows)
    assert linededup.deduplicate(docs.limit(0)).count() == 0


def test_hot_lines_take_the_broadcast_way(spark):
    rows = [(i, f"a line that all documents hold\nline {i % 667} held by a few documents") for i in range(2_001)]
    docs = plain.docs(spark, rows)
    common = linededup.repeated_lines(docs)
    assert common.where("seen * 1000 >= 4002").count() == 1 and common.where("seen = 3").count() == 667
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.deduplicate(docs).collect()), key=str)
    assert got == _kept_lines(rows)


def _audit(rows, labels):
    fails = {}
    for at, (i, t, _) in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails[at] = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(fails[at], rows[at][0]) for at in range(len(rows)) if (rows[at][2] or "") == part]
        summed = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for at, x in enumerate(order):
                gone = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                summed[x] += len(gone)
                steps.append([part, "".join(order), at + 1, len(left), len(gone), sum(f[x] for f, _ in mine) - len(gone), sum(f[x] and sum(f.values()) == 1 for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)])
        for s in steps:
            out[tuple(s[:3])] = (*s[3:], summed[s[1][s[2] - 1]])
    return out


def test_audit_matches_brute_force(spark):
    varied = " ".join(f"word{i}" for i in range(60))
    texts = [varied, varied + " #", varied.upper(), "short", "a " * 80, None, "", "SHORT | x", "A " * 60 + "$", varied + "\x0b%", "ä " * 49 + "é", " ".join(["x"] * 18 + [f"y{i}" for i in range(32)])]
    rows = [(i, texts[i % len(texts)], [None, "", "s1", "s2"][i % 7 % 4]) for i in range(60)]
    rows += [(None, varied, "s1"), (None, "short", None), (3, "short", "s2"), (3, "short", "s1"), (3, "other text of three", "s1"), (90, "x " * 200_000, "s3"), (91, "#" * 300_000, "s3")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (5, None, None), (777, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, "x", 5) for i, t, s in rows], "doc_id long, text string, source string, mask int, part string, _seen int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.audit(docs, marks).collect()}
    assert got == _audit(rows, labels) and len(got) == 600 * 4
    assert {tuple(r)[7:9] for r in filteraudit.audit(docs, marks.limit(0)).collect()} == {(0, 0)}
    assert filteraudit.audit(docs.limit(0), marks).count() == 0


def test_swaps_reach_every_order_and_keep_the_diagram():
    counts = {m: (m + 1, m % 3, m % 2) for m in range(32) if m % 5}
    diagram = filteraudit.Diagram("ABCDE", counts, 3)
    seen = {"ABCDE"}
    for i in filteraudit.neighbour_swaps(5):
        diagram.swap(i)
        seen.add("".join(diagram.order))
        moved = {sum(1 << diagram.order.index(x) for b, x in enumerate("ABCDE") if m >> b & 1): c for m, c in counts.items()}
        fresh = filteraudit.Diagram("".join(diagram.order), moved, 3)
        assert list(diagram.steps()) == list(fresh.steps()) and [len(x) for x in diagram.levels] == [len(x) for x in fresh.levels]
    assert len(seen) == 120
    same = filteraudit.Diagram("ABCDE", dict.fromkeys(range(32), (1, 0, 0)), 3)
    assert [len(x) for x in same.levels] == [1] * 5
