"""The filter audit, the lookup sketches and the resampling against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pricelode.llm import interactions, resample, sketches

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    out = {}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j < i for j in ids[t])}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for key in out:
            if key[0] == part and len(out[key]) == 6:
                out[key].append(share[key[1][key[2] - 1]])
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_audit(spark, awkward, empty):
    rng = random.Random(1)
    texts = [None, "", "UP", "a # b", " ".join(f"w{i}" for i in range(120)), " ".join(["x"] * 130), " ".join(f"W{i}" for i in range(110)) + " | "]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "en", "", "de"])) for _ in range(90)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    got = audited(interactions.audit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)))
    assert got == plain_audit(docs, labels)
    given = [(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()]
    clash = awkward.withColumn("digest", F.lit(1)).toDF("doc_id", "text", "lang", "Text", "mask", "n")
    assert audited(interactions.audit(clash, spark.createDataFrame([], LABELS))) == plain_audit(given, [])
    assert interactions.audit(empty, spark.createDataFrame(labels, LABELS)).count() == 0


def digests(t):
    return {p for p in re.split(r"(?<=[.!?])\s+|\n", t or "", flags=re.ASCII) if p}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_versions(spark, docs):
    """docs must have distinct, given ids."""
    docs = sorted(docs)
    out = []
    for k, (i, t) in enumerate(docs):
        t, following = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(digests(t), digests(edited)), likeness(digests(t), digests(following))))
    return out


def sketched(df):
    return sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect())


@pytest.mark.parametrize("n_bytes", [1 << 12, 32 << 20])
def test_sketches(spark, documents, n_bytes):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    out = sketches.report(documents.select("doc_id", "text").repartition(5), n_bytes)
    assert sketched(out) == plain_versions(spark, docs)
    prints = defaultdict(set)
    for r in out.join(documents, "doc_id").collect():
        prints[r["text"]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len(prints) > 100
    assert len({f for x in prints.values() for f in x}) == len(prints)


def test_sketches_tried_again(spark):
    """Few rounds of peeling leave most pairs stuck at first; larger sketches settle them all."""
    rng = random.Random(2)
    docs = [(i, "\n".join(f"line {rng.randint(0, 90)}." for _ in range(rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sketched(sketches.report(df, rounds=3)) == plain_versions(spark, docs)


def test_sketches_awkward(spark, awkward, empty):
    df = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
    clash = df.withColumn("range", F.lit(1)).toDF("doc_id", "text", "TEXT", "own", "nth", "range")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sketched(sketches.report(clash)) == plain_versions(spark, docs)
    every = sketches.report(awkward).collect()
    assert len(every) == awkward.count() and sum(r["doc_id"] is None for r in every) == 1
    assert sketches.report(empty).count() == 0
    one = sketches.report(spark.createDataFrame([(7, "Alone. Here.")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"Alone.Alone.").hexdigest()
    same = spark.createDataFrame([(7, "One.\nTwo."), (7, "One.\nTwo."), (None, None), (None, ""), (-(1 << 63), "x")], "doc_id long, text string")
    assert sorted(r["near_next"] for r in sketches.report(same).collect()) == [0.0, 0.0, 0.0, 1.0, 1.0]


def plain_draw(docs, target):
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return ws, [zlib.crc32(x.encode()) % 10000 for x in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        ws, bs = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in bs]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= 20])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = n
    return sorted(((*r[:4], r[4] if r[4] is not True and r[4] else None) for r in rows), key=str)


def drawn(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_resampling(spark, sf, documents, awkward, empty):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    target = [r["text"] for r in benchmark.collect()]
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert drawn(resample.report(documents.repartition(3), benchmark)) == plain_draw(docs, target)
    clash = awkward.toDF("doc_id", "text", "Text", "n_words", "score")
    assert drawn(resample.report(clash, benchmark.limit(0))) == plain_draw([(r["doc_id"], r["text"]) for r in awkward.collect()], [])
    assert resample.report(empty, benchmark).count() == 0


def test_resampling_in_small_pieces(spark, awkward, documents, monkeypatch):
    texts = [r["text"] for r in documents.limit(60).collect()]
    import pyarrow as pa

    whole = [x for p in resample.pieces(pa.array(texts)) for x in resample.features(p)[0].tolist()]
    monkeypatch.setattr(resample, "AT_ONCE", 1000)
    parts = list(resample.pieces(pa.array(texts)))
    assert len(parts) > 5 and [x for p in parts for x in resample.features(p)[0].tolist()] == whole
