"""Slot sharding against a plain version; the network's layout, and its held-out accuracy on a small fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from pricelode.llm import bytecnn, slots
from pricelode.llm.ngramlr import joined


def check(rows, docs, n_shards):
    assert len(rows) == len(docs)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < n_shards and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[r["virtual_slot"]].add(r["shard"])
    assert all(len(x) == 1 for x in shard_of.values())


def test_shards(spark, documents, awkward, empty):
    docs = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    rows = slots.shard(docs).collect()
    check(rows, [tuple(r) for r in docs.collect()], 40)
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = Counter()
    for r in slots.shard(big, n_shards=8).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.02 * min(load.values())
    assert slots.shard(empty).count() == 0


def test_plain_placement(spark, documents, awkward):
    """Every row's shard and place, worked out row by row."""
    import xxhash

    docs = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    rows = []
    for i, t in docs.collect():
        data = (t or "").encode()
        crc = zlib.crc32(data)
        key = crc if i is None else i
        rows.append((int.from_bytes(xxhash.xxh64(key.to_bytes(8, "little", signed=True), 42).digest(), "big", signed=True) % 64, i, crc, len(data) + 16))
    load = Counter()
    for v, _, _, size in rows:
        load[v] += size
    total, shard = [0] * 7, {}
    for v in sorted(range(64), key=lambda v: (-load[v], v)):
        shard[v] = min(range(7), key=lambda s: (total[s], s))
        total[shard[v]] += load[v]
    want, filled = [], [0] * 7
    for v, i, crc, size in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3])):
        want.append((i, size, crc, shard[v], filled[shard[v]]))
        filled[shard[v]] += 1
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in slots.shard(docs, n_shards=7, n_slots=64).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_plain_convolution():
    """The network's scores, one window after another."""
    rng = np.random.default_rng(3)
    net = bytecnn.untrained(5)
    net.out, net.bias, net.shift = rng.normal(0, 1, 2 * bytecnn.FILTERS), rng.normal(0, 0.1, bytecnn.FILTERS).astype(np.float32), 0.3
    texts = [b"", b"a", bytes(range(256)) * 2, "ünï 漢字 ".encode() * 150, b"x" * 513, rng.integers(0, 256, 1300, np.uint8).tobytes()]
    got = net.scores(*joined(texts))
    for text, score in zip(texts, got, strict=True):
        pooled, at = [], 0
        while True:
            ids = list(text[at : at + bytecnn.CHUNK])
            ids += [bytecnn.PAD] * (bytecnn.CHUNK - len(ids))
            answers = [net.embed[ids[p : p + bytecnn.WIDTH]].reshape(-1) @ net.filters for p in range(0, bytecnn.CHUNK - bytecnn.WIDTH + 1, bytecnn.STEP)]
            pooled.append(np.maximum(np.max(answers, axis=0) + net.bias, 0))
            if at + bytecnn.CHUNK >= len(text):
                break
            at += bytecnn.CHUNK - bytecnn.OVERLAP
        z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ net.out + net.shift
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_plain_probability():
    """The n-gram model's probability, one n-gram after another."""
    from pricelode.llm import ngramlr
    from pricelode.llm.bytesops import Spans

    rng = np.random.default_rng(4)
    model = ngramlr.Model(rng.normal(0, 2, (ngramlr.FAMILIES, 1 << ngramlr.BITS)).astype(np.float32), -0.2, 1.3, 0.4)

    def hashed(gram: bytes) -> int:
        return int(Spans(np.frombuffer(gram, np.uint8)).of(np.array([0]), np.array([len(gram)]))[0])

    texts = [b"", b"ab", b"one two two three\none", "ünï 漢字 emoji".encode(), b"  spaced   out  "]
    got = model.probability(*joined(texts))
    for text, p in zip(texts, got, strict=True):
        words = [hashed(w) for w in text.split()]
        pairs = [0 if a == b else (a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(words, words[1:], strict=False)]
        families = [[hashed(text[i : i + n]) for i in range(len(text) - n + 1)] for n in ngramlr.CHARS] + [words, pairs]
        z = model.bias + sum(np.mean([model.weight[f][h >> (64 - ngramlr.BITS)] for h in family]) for f, family in enumerate(families) if family)
        assert abs(p - 1 / (1 + np.exp(-(model.slope * z + model.shift)))) < 1e-6


def test_maps(spark, tmp_path):
    rng = random.Random(1)
    load = {i: rng.randrange(1, 1000) for i in range(2000)}
    first = slots.balanced(load, 10, 2000)
    total = lambda m: [sum(load[i] for i, s in enumerate(m.shard) if s == k) for k in range(m.n_shards)]
    assert max(total(first)) - min(total(first)) <= 1000
    grown = slots.grow(first, load)
    assert grown.version == 2 and all(grown.shard[i] == 10 for i in first.moved(grown)) and max(total(grown)) < 1.03 * min(total(grown))
    heavier = {i: v * (5 if first.shard[i] == 0 else 1) for i, v in load.items()}
    moved = slots.rebalance(first, heavier)
    new = [sum(heavier[i] for i, s in enumerate(moved.shard) if s == k) for k in range(10)]
    assert max(new) < 1.05 * min(new) and len(first.moved(moved)) < 400 and moved.version == 2
    path = f"file://{tmp_path}/maps"
    for m in (first, grown):
        slots.save_map(spark, m, path)
    assert slots.load_map(spark, path) == grown and slots.load_map(spark, path, 1) == first


def test_chunks_cover_all():
    texts = [b"", b"a", b"x" * 511, b"x" * 512, b"x" * 513, b"ab" * 3000]
    data, offsets = joined(texts)
    start, first = bytecnn.laid_out(data, offsets)
    for i, t in enumerate(texts):
        own = start[first[i] : first[i + 1]] - offsets[i]
        assert len(own) >= 1 and own[0] == 0 and (not t or own[-1] + bytecnn.CHUNK >= len(t)) and (np.diff(own) == bytecnn.CHUNK - bytecnn.OVERLAP).all()


def test_scores_stand_alone():
    net = bytecnn.untrained()
    net.out[:] = np.random.default_rng(0).normal(size=len(net.out))
    texts = [b"", b"short", b"longer text " * 100, "é漢".encode() * 400]
    together = net.scores(*joined(texts))
    assert np.allclose(together, [net.scores(*joined([t]))[0] for t in texts], atol=1e-6)
    assert ((together >= 0) & (together <= 1)).all() and len(net.scores(*joined([]))) == 0


def test_gradients():
    net = bytecnn.untrained()
    rng = np.random.default_rng(3)
    net.out[:] = rng.normal(size=len(net.out))
    texts, y, part = [b"some words here " * 40, b"### %%% " * 30], np.array([1.0, 0.0]), np.array([0.5, 0.5])

    def loss():
        p = net.scores(*joined(texts))
        return float(-(part * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 2 + 5e-5 * (net.out**2).sum())

    grads = bytecnn.gradients(net, texts, y, part, net.shift)
    for values, grad in zip((net.embed, net.filters, net.bias, net.out), grads, strict=False):
        flat, g = values.reshape(-1), np.asarray(grad).reshape(-1)
        for k in np.argsort(-abs(g))[:3]:
            old, step = flat[k], 1e-3
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[k]) < 0.05 * abs(g[k]) + 2e-4


def test_held_out(spark, awkward, empty, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = bytecnn.trained(docs, labels)
    got = {r["doc_id"]: r for r in bytecnn.scored(docs, net, ["doc_id"]).collect()}
    truth = [(r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(got[i]["score"] >= bytecnn.THRESHOLD) == (q == 1) for i, q in truth]) > 0.9
    assert len(bytecnn.scored(awkward, net, ["doc_id"]).collect()) == awkward.count() and bytecnn.scored(empty, net, ["doc_id"]).count() == 0
    none = bytecnn.report(awkward, labels.limit(0)).collect()
    assert all(r["score"] > 0.99 and r["predicted"] == 1 for r in none)
    assert {r["doc_id"]: r["held_out"] for r in none if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in [*range(17), 100]}
