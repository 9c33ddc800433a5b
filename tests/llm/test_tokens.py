"""Token store: exact round trips, and the library's own ids."""

import random
import time
import zlib

import numpy as np
import pytest

from pricelode.llm import rangecoder, tokenstore


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 1000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.zeros(n, int), rng.integers(0, 3, n), np.resize([0, 131071, 65535, 65536, 1], n)):
        assert rangecoder.decode_blocks(rangecoder.encode_blocks(ids, 64)).tolist() == ids.tolist()


def test_repeats_cost_little():
    ids = np.tile(np.random.default_rng(1).integers(0, 50257, 20), 400)
    assert len(rangecoder.encode_blocks(ids, 4096)) < 0.2 * 2 * len(ids)


def test_damage_is_seen():
    data = bytearray(rangecoder.encode_blocks(np.arange(3000) % 700, 512))
    data[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rangecoder.decode_blocks(bytes(data))
    with pytest.raises(ValueError, match="not a token segment"):
        rangecoder.decode_blocks(b"xxxx" + bytes(20))


def test_chunks_match_the_library():
    e = tokenstore.Encoder(tokenstore.tokenizer_path())
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "word", "'s", "'ll", "12", "Ünï", "漢字", "😀", "\x85", "\xa0", " ", "\x1c", "\x1f", ".", "!?", "_", "\x00", "<|endoftext|>", "é", "​", "᠎"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_report(spark, documents, awkward, monkeypatch):
    docs = documents.select("doc_id", "text").unionByName(awkward.filter("doc_id is null").select("doc_id", "text")).unionByName(awkward.filter("doc_id < 90").selectExpr("doc_id + 1000 as doc_id", "text").distinct())
    e = tokenstore.Encoder(tokenstore.tokenizer_path())
    want, start = [], 0
    for i, t in sorted(((r[0], r[1]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*e.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenstore.report(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_segments(spark, documents, empty, tmp_path):
    tokenstore.write(documents, f"file://{tmp_path}/a", segment=40000)
    store = tokenstore.read(spark, f"file://{tmp_path}/a")
    assert store.count() > 2
    e = tokenstore.Encoder(tokenstore.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in tokenstore.ids(store).collect():
        assert r["ids"] == [*np.frombuffer(e.encode(texts[r["doc_id"]]), "<u4").tolist(), 0]
    assert tokenstore.report(empty).count() == 0


def test_coding_beats_a_table_of_frequencies():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 300_000), 50_000)
    ids[1::2] = np.where(rng.random(150_000) < 0.5, ids[::2] * 7 % 50_000, ids[1::2])
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    start = time.process_time()
    data = rangecoder.encode_blocks(ids)
    assert np.array_equal(rangecoder.decode_blocks(data), ids)
    assert time.process_time() - start < 2.5  # 73 lanes of 4096 steps took longer
    assert len(data) * 8 < -1.05 * (share * np.log2(share)).sum() * len(ids)


def test_damage_gives_no_wrong_ids():
    ids = np.random.default_rng(4).zipf(1.5, 5000) % 900
    data = rangecoder.encode_blocks(ids, 512)
    seen = 0
    for at in range(20, len(data), 41):
        bad = bytearray(data)
        bad[at] ^= 255
        try:
            assert np.array_equal(rangecoder.decode_blocks(bytes(bad)), ids)  # the last bits of a block may not matter
        except ValueError:
            seen += 1
    assert seen > 50
    with pytest.raises(ValueError, match="below 131072"):
        rangecoder.encode_blocks(np.array([1 << 17]))


def test_batches_match_the_library(monkeypatch):
    e = tokenstore.Encoder(tokenstore.tokenizer_path())
    monkeypatch.setattr(tokenstore, "TABLE", 500)
    rng = random.Random(5)
    parts = [*" \t\n\r\x85\xa0\u1680\u2000\u2007\u2028\u202f\u205f\u3000\u200b\x1c'.-,!0a", "  ", "\n\n", "Word", "don't", "I'LL", "'re", "é", "Él", "漢", "e\u0301", "ß", "×", "÷", "ǅ", "\u0250", "😀", "<|endoftext|>", "<|endoftext|", "\x00"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(100)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ids, n = e.encode_batch(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
        want = [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    assert len(e.table) < 3000  # begun anew when full
