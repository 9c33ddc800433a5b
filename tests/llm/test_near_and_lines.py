"""Near duplicates and line dedup, against plain versions; the pipeline, stage by stage."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricelode.llm import bytecnn, interactions, pieces, pii, repeats, resample, sketches, slots, tokenstore
from pricelode.llm import decontam, linededup, neardup, ngramlr


def shingles(t):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def plain_classes(texts):
    """Class of each text by all pairs."""
    s = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = sum((s[i] & s[j]).values())
            if both and both >= 0.8 * (sum(s[i].values()) + sum(s[j].values()) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(s))]


def edited(rng, t, n):
    w = t.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def family(spark, documents):
    rng = random.Random(4)
    texts = [r[0] for r in documents.select("text").orderBy("doc_id").collect()]
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    # the copies are alike to the base but less so to each other
    texts += [edited(rng, base, 4) for _ in range(15)] + [base] + [base.upper()] + ["one two", "One, two!", "one two three", "", None, "?!"]
    return texts


def test_classes(spark, family):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(family)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in neardup.classes(docs).collect()}
    want = plain_classes(family)
    assert [got[i]["class_id"] for i in range(len(family))] == want
    sizes = Counter(want)
    assert all(got[i]["class_size"] == sizes[c] and got[i]["keep"] == (i == c) for i, c in enumerate(want))
    kept = neardup.deduped(docs.unionByName(docs.filter("doc_id = 3")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def unlike_their_hubs(rng):
    """A popular text with copies, and pairs alike to each other but to nothing popular, all in the same buckets."""
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [edited(rng, " ".join(base), 2) for _ in range(12)]
    for i in range(5):  # twins that both lack the base's end; each pair has its own
        twin = " ".join(base[:158] + [f"own{i}x{rng.randrange(5000)}" for _ in range(42)])
        texts += [twin, twin + f" tail{i} more{i}"]
    # lone texts of the same beginning: classes that come before the twins'
    texts += [" ".join(base[:160] + [f"lone{i}x{rng.randrange(5000)}" for _ in range(40)]) for i in range(10)]
    # a chain: neighbours are alike, its ends are not, and none is alike to the base
    chain = base[:150] + [f"chain{rng.randrange(5000)}" for _ in range(60)]
    return texts + [" ".join(chain[:100] + [f"c{j}" if k < 9 * i else chain[100 + k] for k, j in enumerate(range(9 * i, 9 * i + 110))]) for i in range(5)]


@pytest.mark.parametrize("block", [neardup.BLOCK_BYTES, 5000])
def test_links_beside_the_hubs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    texts = unlike_their_hubs(random.Random(11))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketch = neardup.sketches(docs).withColumnsRenamed({"doc_id": "first_id", "n": "size"})
    # one bucket for all: every text meets every other, and the most popular hub is unlike most
    nodes = sketch.withColumn("node", F.col("first_id")).withColumn("bands", F.array(F.lit(1).cast("long")))
    got = {r["node"]: r["label"] for r in neardup.linked(docs, nodes).collect()}
    want = plain_classes(texts)
    assert len(set(want)) < len(want) and len({(got[i], c) for i, c in enumerate(want)}) == len(set(want)) == len(set(got.values()))


@pytest.mark.parametrize("block", [neardup.BLOCK_BYTES, 20_000])
def test_recall_in_a_large_family(spark, monkeypatch, block):
    """Variants of one text at all distances, many of them out of its reach: the classes of all pairs, through the real bands."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block)
    rng = random.Random(23)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    texts = [base] + [edited(rng, base, rng.choice([1, 1, 2, 3, 4, 5, 6, 8, 12])) for _ in range(140)]
    for _ in range(8):  # families of the family
        again = edited(rng, rng.choice(texts), 5)
        texts += [edited(rng, again, rng.choice([1, 2, 3])) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    want = plain_classes(texts)
    links = [(i, j) for j in range(len(texts)) for i in range(j) if want[i] == want[j]]
    assert len(set(want)) > 10 and all(want[i] == want[got[i]] for i in range(len(texts)))
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)


CLASHES = ["n_hit", "items", "n_words", "hit_spans", "n_lines_removed", "kept", "probability", "base_failed", "_own", "_id", "_tkey", "_spans", "_text", "_label", "k0", "k1", "_k0", "label", "node", "class_id", "a.b", "h 1"]


def test_columns_of_any_name(spark, documents):
    """Every stage carries extra columns through, whatever they are called."""
    names = [*documents.columns, *CLASHES]
    docs = documents.limit(60).select(*documents.columns, *(F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")) for i in range(len(CLASHES)))).toDF(*names)
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    items = spark.createDataFrame([("x", "some words that are nowhere in any of these documents at all")], "item_id string, text string")
    plain = {r["doc_id"]: r for r in docs.collect()}
    for out in (ngramlr.passed(docs, labels), linededup.left(docs), neardup.deduped(docs), decontam.clean(docs, items)):
        assert out.columns == names
        rows = out.collect()
        assert rows
        for r in rows:
            assert list(r[5:]) == list(plain[r["doc_id"]][5:])


def test_names_equal_but_for_case(spark, sf, documents):
    """Further columns Text and DOC_ID make nothing ambiguous, in any operator."""
    docs = documents.limit(40).withColumn("_", F.lit("other")).withColumn("__", F.lit(5))
    docs = docs.toDF(*docs.columns[:-2], "Text", "DOC_ID")
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"), F.lit(1).alias("Quality"))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("more", F.lit("x")).toDF("item_id", "text", "Item_ID")
    one = [repeats.report, neardup.report, linededup.report, tokenstore.report, pii.report, slots.shard, pieces.report, sketches.report]
    for f in one:
        assert f(docs).count() == 40
    assert decontam.report(docs, items).count() == resample.report(docs, items).count() == 40
    assert bytecnn.report(docs, labels).count() == ngramlr.report(docs, labels).count() == 40
    assert interactions.audit(docs, labels).count() % 600 == 0
    for out in (ngramlr.passed(docs, labels), linededup.left(docs), neardup.deduped(docs), decontam.clean(docs, items)):
        assert out.columns == docs.columns and out.count() <= 40


def test_near_copies_without_ids(spark):
    """Texts without an id are told apart by their digests: each kind of text is read once, not once for each node."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, words(k)) for k in range(30) for _ in range(2)] + [(k, words(k) + " end") for k in range(30)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["class_id"] for r in got) == sorted(k for k in range(30) for _ in range(3))


def test_awkward_near(awkward, empty):
    got = neardup.classes(awkward).collect()
    assert len(got) == awkward.count()
    assert neardup.classes(empty).count() == 0 and neardup.deduped(empty).count() == 0


def plain_lines(docs):
    """Kept text of each (doc_id, text) in the order of ids."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for a, b, c in zip(solid, solid[1:], solid[2:]):
            key = tuple(lines[k].rstrip(" \t\r\x0b\x0c") for k in (a, b, c))
            if key in seen:
                gone.update(range(a, c + 1))
            seen.add(key)
        keep = [k not in gone for k in range(len(lines))]
        for k in range(1, len(lines) - 1):
            if keep[k] and k not in solid:
                before = next((x for x in range(k, -1, -1) if x in solid or not keep[x]), None)
                after = next((x for x in range(k, len(lines)) if x in solid or not keep[x]), None)
                if before is not None and after is not None and not keep[before] and not keep[after]:
                    gone.add(k)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines(spark, documents):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(6)] + ["", "  ", "tail  "]
    rows = [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]
    rows += [(1000 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(80)] + [(None, "line 1\nline 2\nline 3"), (3000, None), (3001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.deduped(docs).collect()} == plain_lines(rows)


def test_awkward_lines(awkward, empty):
    got = linededup.report(awkward).collect()
    assert len(got) == awkward.count()
    assert linededup.report(empty).count() == 0
    assert linededup.left(awkward).columns == awkward.columns


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    steps = [docs]
    for _, stage in p.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].columns == docs.columns
    model = ngramlr.trained(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    p1 = {i: t for i, t in rows if not ngramlr.counts(t.encode())[5] and model.probability(*ngramlr.joined([t.encode()]))[0] >= ngramlr.THRESHOLD}
    assert {r["doc_id"]: r["text"] for r in steps[1].collect()} == p1
    p2 = {i: t for i, t in plain_lines(p1.items()).items() if t.strip() or t == p1[i]}
    assert {r["doc_id"]: r["text"] for r in steps[2].collect()} == p2
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())
    ids = sorted(p2)
    keep = {ids[c] for c in plain_classes([p2[i] for i in ids])}
    assert {r["doc_id"] for r in steps[3].collect()} == keep
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [decontam.words_of(r["text"])]]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9))}
    clean = {i for i in keep if not any(tuple(decontam.words_of(p2[i])[k : k + 10]) in windows for k in range(len(decontam.words_of(p2[i]))))}
    assert {r["doc_id"] for r in steps[4].collect()} == clean
    last = p.run(spark, sf)
    assert {r["doc_id"] for r in last.collect()} == clean
