"""Benchmark decontamination over a positional inverted index that is split by document.

Every task turns its documents into an index shard: the corpus words that occur in a test
window get a term id, and the shard keeps their sorted positions per term (its postings).
Test windows are looked up in every shard: the postings of a window's rarest term give
candidate starts (position minus offset), which are then intersected, rarest first, with the
offset-adjusted postings of the other terms. ``slack`` = 0 asks for exact phrases; above
that, each term may stand up to ``slack`` words from its place beside the rarest one, within its document (proximity).
The index of a shard lives while the shard is searched; its postings aren't kept as a table, for they would be as large
as the words of the corpus that occur in a test item.

Documents are never shuffled. Test items travel to the shards in blocks of at most
``block_bytes``, measured before they are sent; a larger test set only means more blocks, each
of which sees all documents.

Defined cases: a null or wordless text has no words and is clean; an item without words has no
window; an item shorter than a window is one window; equal items are each reported; repeated
rows are each reported; an empty test set leaves everything clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bytesops import chunks, column_bytes, runs, take_spans
from pricelode.llm.storage import aliased, picked, with_fields

#: The words of lower-cased UTF-8: digits, letters, and every byte of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Candidates that are checked at once.
AT_ONCE = 1 << 20

RESULT = "n_words long, n_hit long, hit_spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | str | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(data.lower())


class Windows:
    """The test windows of one block: a row of term ids each, and the item that it came from."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.width = width
        self.terms: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str] = []
        for name, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            if ids:
                self.names.append(name)
                for i in range(max(1, len(ids) - width + 1)):
                    rows.setdefault(tuple(ids[i : i + width]), set()).add(len(self.names) - 1)
        self.size = np.array([len(r) for r in rows], np.int64)
        self.rows = np.full((len(rows), width), -1, np.int64)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        self.owners = [sorted(x) for x in rows.values()]
        self.owner_first = np.cumsum([0, *map(len, self.owners)])
        self.owner_flat = np.array([x for o in self.owners for x in o], np.int64)


def lookup(windows: Windows, ids: np.ndarray, doc: np.ndarray, slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start position, document) of the occurrences in one shard. ids: each word's term or -1.

    With ``slack`` the start is that of the rarest term's place; the window may reach over its document's edges by as much."""
    n_terms, n = len(windows.terms), len(ids)
    if not len(windows.rows) or not n:
        return
    known = np.flatnonzero(ids >= 0)
    postings = known[np.argsort(ids[known], kind="stable")]  # positions by term, each term's in order
    code = ids[postings] * n + postings  # the same as one sorted list, for intersections
    count = np.bincount(ids[known], minlength=n_terms)
    first = np.cumsum(count) - count
    freq = np.where(windows.rows >= 0, count[windows.rows], np.iinfo(np.int64).max)
    order = np.argsort(freq, axis=1, kind="stable")
    which = np.flatnonzero(freq[np.arange(len(freq)), order[:, 0]] > 0)
    which = which[(freq[which] > 0).all(axis=1)]
    rarest = windows.rows[which, order[which, 0]]
    upto = np.cumsum(count[rarest])
    begins = np.searchsorted(doc, np.arange(doc[-1] + 2))
    begins, ends = begins[:-1], begins[1:]
    at = 0
    while at < len(which):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + AT_ONCE, side="right")))
        w, t = which[at:to], rarest[at:to]
        hit = np.repeat(w, count[t])
        place = postings[take_spans(first[t], count[t])]
        own, start = doc[place], place - order[hit, 0]
        ok = (start >= begins[own] - slack) & (start + windows.size[hit] <= ends[own] + slack)
        hit, start, own = hit[ok], start[ok], own[ok]
        for k in range(1, windows.width):
            if not len(hit):
                break
            offset = order[hit, k]
            term = windows.rows[hit, offset]
            # the term's postings, moved back by its offset, meet the starts (give or take the slack)
            low = np.maximum(start + offset - slack, begins[own])
            high = np.minimum(start + offset + slack, ends[own] - 1)
            base = np.maximum(term, 0) * n
            found = np.searchsorted(code, base + high, side="right") > np.searchsorted(code, base + low)
            ok = (term < 0) | (found & (low <= high))
            hit, start, own = hit[ok], start[ok], own[ok]
        if len(hit):
            yield hit, start, own
        at = to


def shard_matches(windows: Windows, texts: list[bytes], slack: int = 0) -> list[tuple[int, np.ndarray, list[str]]]:
    """Per document: words, a mask of the hit ones, and the items with an occurring window."""
    found, get = [], windows.terms.get
    parts, lengths = [], []
    for t in texts:
        words = WORD.findall(t.lower())
        lengths.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    bounds = np.cumsum([0, *lengths])
    doc = np.repeat(np.arange(len(texts)), lengths)
    edge = np.zeros(len(ids) + 1, np.int64)
    pairs: set[tuple[int, int]] = set()
    for hit, start, own_doc in lookup(windows, ids, doc, slack):
        np.add.at(edge, np.maximum(start, bounds[own_doc]), 1)
        np.add.at(edge, np.minimum(start + windows.size[hit], bounds[own_doc + 1]), -1)
        n = windows.owner_first[hit + 1] - windows.owner_first[hit]
        own = windows.owner_flat[take_spans(windows.owner_first[hit], n)]
        code = np.unique(np.repeat(own_doc, n) * len(windows.names) + own)
        pairs.update(zip((code // len(windows.names)).tolist(), (code % len(windows.names)).tolist(), strict=True))
    mask = np.cumsum(edge[:-1]) > 0
    items: dict[int, list[str]] = {}
    for d, i in pairs:
        items.setdefault(d, []).append(windows.names[i])
    for d in range(len(texts)):
        found.append((lengths[d], mask[bounds[d] : bounds[d + 1]], items.get(d, [])))
    return found


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The test set in blocks of bounded size, one on the driver at a time."""
    sized = picked(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = sized.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = total // block_bytes + 1
    for k in range(n):
        part = sized if n == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0] or "", r[1]) for r in part.collect()]


def matched(frame: DataFrame, text: str, items: DataFrame, width: int = WINDOW, slack: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``frame`` with n_words, n_hit, hit_spans (in words) and items for its column ``text``; its own names must not be of these."""
    spark, kept, at = frame.sparkSession, frame.columns, frame.columns.index(text)
    schema = with_fields(frame, RESULT)
    for k, block in enumerate(blocks(items, block_bytes)):
        sent = spark.sparkContext.broadcast(block)

        def shard(batches: Iterator[pa.RecordBatch], sent=sent, later=k > 0) -> Iterator[pa.RecordBatch]:
            windows = Windows(sent.value, width)
            for batch in batches:
                data, offsets = column_bytes(batch.column(at))
                whole, out = data.tobytes(), []
                old = batch.select(["hit_spans", "items"]).to_pylist() if later else None
                for i, j in chunks(offsets):
                    texts = [whole[offsets[d] : offsets[d + 1]] for d in range(i, j)]
                    for d, (n, mask, found) in enumerate(shard_matches(windows, texts, slack), i):
                        if old:
                            for s in old[d]["hit_spans"]:
                                mask[s["start"] : s["end"]] = True
                            found = [*found, *old[d]["items"]]
                        a, b = runs(mask)
                        out.append((n, int(mask.sum()), [{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist(), strict=True)], sorted(set(found))))
                n, hit, spans, found = zip(*out, strict=True) if out else ((), (), (), ())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                arrays = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *arrays], [*kept, "n_words", "n_hit", "hit_spans", "items"])

        frame = frame.mapInArrow(shard, schema)
    return frame


def matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, slack: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``' columns, whatever their names, followed by n_words, n_hit, hit_spans (in words) and items."""
    frame, name = aliased(docs)
    return matched(frame, name["text"], items, width, slack, block_bytes).toDF(*docs.columns, "n_words", "n_hit", "hit_spans", "items")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: how many of its words a test window covers, and of which items."""
    return matched(picked(docs, "doc_id", "text"), "text", items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a test window, with ``docs``' columns whatever their names."""
    frame, name = aliased(docs)
    return matched(frame, name["text"], items).filter(F.col("n_hit") == 0).select(*frame.columns).toDF(*docs.columns)
