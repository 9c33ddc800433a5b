"""Repeated passages, against all windows by brute force."""

import random

import pytest

from pricelode.llm import repeats


def cases(documents, awkward):
    rng = random.Random(1)
    base = ["".join(rng.choice("abc d") for _ in range(3000)) for _ in range(3)]
    noise = lambda: "".join(rng.choice("xyzé ") for _ in range(rng.randrange(300)))
    rows = []
    for i in range(60):
        b, a, n = rng.choice(base), rng.randrange(2000), rng.randrange(100, 1500)
        rows.append((1000 + i, noise() + b[a : a + n] + noise()))
    rows += [(2001, "a" * 1000), (2004, "x" * 399), (2004, "x" * 400), (2005, "lorem ipsum " * 50), (2005, "lorem ipsum " * 50), (2006, "".join(map(str, range(120)))), (2007, "".join(map(str, range(120)))), (None, "q" + "lorem ipsum " * 40)]
    frame = documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    return documents.limit(80).select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).unionByName(frame)


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_removed(documents, awkward, group):
    docs = cases(documents, awkward)
    rows = [(r[0], (r[1] or "").encode()) for r in docs.collect()]
    want = sorted((str(i), *x[:3], x[3]) for (i, _), x in zip(rows, repeats.plain([t for _, t in rows]), strict=True))
    out = repeats.removed(docs, group=group).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "size(spans)", "sha2(kept, 256)", "passages")
    got = out.collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == want
    assert sum(x[2] for x in want) > 10_000
    # shorter repeats are told, not cut: all runs of 256-byte windows that have many words
    passages = [(str(i), [(a, b) for a, b in x if len(t[a:b].split()) > repeats.PASSAGE_WORDS]) for (i, t), x in zip(rows, repeats.plain_runs([t for _, t in rows], repeats.SHORT), strict=True)]
    told = sorted((str(r[0]), [(x["start"], x["end"]) for x in r[5]]) for r in got)
    assert all(set(want_) <= set(got_) for (_, want_), (_, got_) in zip(sorted(passages), told, strict=True))
    everything = {(i, x) for i, xs in [(str(i), x) for (i, _), x in zip(rows, repeats.plain_runs([t for _, t in rows], repeats.SHORT), strict=True)] for x in xs}
    assert {(i, x) for i, xs in told for x in xs} <= everything


def test_runs_of_one_word(spark):
    """Texts full of self-repeating runs, whose edges differ."""
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        word = rng.choice(["the ", "of ", "x", "abcdefghij klmno ", "a b a c "])
        part = lambda: "".join(rng.choice("bcdfgu ") for _ in range(rng.choice([0, 5, 120, 400])))
        texts.append(part() + word * rng.randrange(2, 250) + part() + rng.choice(["the ", word]) * rng.randrange(2, 120) + part())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *x) for i, x in enumerate(repeats.plain([t.encode() for t in texts])))
    out = repeats.report(docs).drop("n_passages").collect()
    assert sorted(tuple(r) for r in out) == want


def test_a_passage_in_very_many_texts(spark):
    """One passage in many texts with other words around it: its edges are one large group, split or not."""
    rng = random.Random(6)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}" for k in range(300)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, short = said(120), said(60)
    texts = [f"{said(20)} {passage} {said(20)}" for _ in range(120)] + [f"{said(rng.randrange(9))} {short[:300]} {said(15)}" for _ in range(60)] + [said(200) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *x) for i, x in enumerate(repeats.plain([t.encode() for t in texts])))
    for group in (repeats.GROUP, 30):
        out = repeats.removed(docs, group=group).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "size(spans)", "sha2(kept, 256)", "size(passages)").collect()
        assert sorted(tuple(r[:5]) for r in out) == want
        assert {r[0] for r in out if r[5]} == set(range(180))


def test_empty(empty):
    assert repeats.report(empty).count() == 0


def test_intervals():
    assert sorted(repeats.intervals([3, 5, 5, 0, 2])) == [(2, 4, 5), (3, 0, 3), (5, 1, 3)]
