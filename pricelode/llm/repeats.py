"""Removal of repeated passages by a distributed sparse suffix array and its interval tree.

A byte goes if a string of ``LENGTH`` (400) bytes that covers it also starts anywhere else. Shorter repeats, of
``SHORT`` (256) bytes or more, are found on the way and told, never cut: they are the passages of ``PASSAGE_WORDS`` words or more.

1. Anchors. Every window of ``SHORT`` bytes has a lowest-hashed ``SEED``-byte substring; equal windows have it at
   equal places. These anchors (about one in 97 bytes) stand for the windows around them, so
   only they are shuffled, as hashes. Anchors whose hash is unique end here.
2. Equal surroundings (all windows of ``LENGTH`` that can hold the anchor) are counted with map-side combining.
   Two or more of one kind are repeats as they stand, whatever their number: exact copies
   and the inside of a common passage never meet in one group.
3. One place of each kind of surroundings goes into the suffix array: the bytes from the anchor on are
   the suffix, those before it the left context. Spark sorts the suffixes within a hash's
   partition; a stack scan of their common prefixes gives the intervals of the common-prefix
   tree; in each interval the left contexts are compared, and where they are diverse, every
   occurrence keeps its longest left extension within the interval. Prefix and extension of ``SHORT`` bytes
   or more together are a maximal repeat with all its occurrences.
4. A task holds a hash's kinds at once, so a hash of more than ``GROUP`` of them (the edge of a passage in very many
   documents) is split by more bytes first (:func:`refined`): two places that share a window also share the
   middle of all windows that begin near it, so the array is built over the places of one middle. Middles grow until a
   group fits, or until they are whole windows, which are repeats as they stand.

Positions are bytes of UTF-8. Defined cases: null and empty texts have no bytes; matches never cross
documents; repeated rows are repeats of each other; rows with one doc_id and one text get one
result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bytesops import Spans, chunks, column_bytes, runs, take_spans
from pricelode.llm.storage import picked, written

LENGTH = 400
SHORT = 256
SEED = 64
#: Longest period of a substring that repeats itself.
PERIOD = 32
PASSAGE_WORDS = 50
#: Kinds of surroundings that a task holds at once, some 30 MB. More of one hash are split first; results are the same.
GROUP = 40_000
#: Into how many middles the windows around an anchor are split at each step.
PARTS = 7
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, width: int, what: np.ufunc, fill: np.uint64) -> np.ndarray:
    """what() over values[i : i + width] for every i; places past the end count as ``fill``."""
    n = len(values)
    blocks = -(-(n + width) // width)
    grid = np.full(blocks * width, fill, np.uint64)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = what.accumulate(grid, axis=1).reshape(-1)
    back = what.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return what(back[:n], ahead[width - 1 : width - 1 + n])


def periodic(data: np.ndarray, seed: int = SEED, most: int = PERIOD) -> np.ndarray:
    """Which substrings of ``seed`` bytes repeat themselves with a period of ``most`` bytes or less; it depends on their bytes alone."""
    n = len(data) - seed + 1
    out = np.zeros(max(n, 0), bool)
    for q in range(1, most + 1 if n > 0 else 1):
        same = data[:-q] == data[q:]
        width = 1
        while 2 * width <= seed - q:  # runs of equal bytes, twice as long at each step
            same = same[:-width] & same[width:]
            width *= 2
        if same.any():
            rest = seed - q - width
            same = same[: len(same) - rest] & same[rest:] if rest else same
            out |= same[:n]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, short: int = SHORT, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of all texts' anchors: hash, hash of the surroundings, text, place in the text, bytes of the surroundings before and after it.

    Substrings that repeat themselves come last in the order of hashes: they are anchors only of windows that hold nothing else, so their
    surroundings end where other substrings begin. Else each edge of a run of one word would have anchors at every word."""
    empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    n = len(data) - seed + 1
    if len(data) < short:
        return empty
    spans = Spans(data)
    dull = periodic(data, seed)
    grams = (spans.every(seed) >> np.uint64(1)) | (dull.astype(np.uint64) << np.uint64(63))
    grams[grams == _NONE] -= np.uint64(1)
    grams[grams == 0] = 1
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the text's end
    grams[room[:n] < seed] = _NONE
    width = short - seed + 1
    least = sliding(grams, width, np.minimum, _NONE)
    least[room[:n] < short] = 0
    # a gram is an anchor if it is the least of a whole window, one of those that start up to width - 1 before it
    most = sliding(least[::-1], width, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((most == grams) & (grams != _NONE))
    doc = np.searchsorted(offsets, at, side="right") - 1
    left = np.maximum(at - (length - seed), offsets[doc])
    right = np.minimum(at + length, offsets[doc + 1])
    own = dull[at]
    if own.any():
        edges = np.flatnonzero(~dull)
        k = np.searchsorted(edges, at[own])
        left[own] = np.maximum(left[own], np.concatenate(([-1], edges))[k] + 1)
        right[own] = np.minimum(right[own], np.append(edges, n)[k] + seed - 1)
    # the anchor's place is part of its surroundings: equal ones are then at different places
    around = spans.of(left, right) + (at - left).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return grams[at], around, doc, at - offsets[doc], at - left, right - at


def anchor_rows(docs: DataFrame, length: int, short: int, seed: int) -> DataFrame:
    names = ["h", "c", "doc_id", "tkey", "pos", "before", "after"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in chunks(offsets):
                h, c, doc, *at = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, short, seed)
                row = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x.astype(t)) for x, t in zip(at, (np.int32, np.int16, np.int16), strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(task, f"h long, c long, doc_id {kind}, tkey long, pos int, before short, after short")


def with_text(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined by (doc_id, tkey) with rows that have few bytes per document."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    other = rows.withColumnsRenamed({"doc_id": "_id", "tkey": "_tkey"})
    return keyed.join(other.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")), how).drop("_id", "_tkey")


def surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h, doc_id, tkey, pos, before (reversed) and after, the bytes of ``places`` (h, doc_id, tkey, pos, before, after: their numbers)."""
    grouped = places.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("h", "pos", "before", "after")).alias("at"))
    rows = with_text(docs, grouped).dropDuplicates(["doc_id", "tkey"]).select("doc_id", "tkey", "text", "at")
    names = ["h", "doc_id", "tkey", "pos", "before", "after"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text = batch.column(2)[k].as_py().encode()
                h, pos, before, after = batch.column(3)[k].values.flatten()  # unlike field(), it heeds the slice
                where = list(zip(pos.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True))
                one = pa.array([k] * len(where), pa.int64())
                bytes_ = [pa.array([text[p - b : p][::-1] for p, b, _ in where], pa.binary()), pa.array([text[p : p + a] for p, _, a in where], pa.binary())]
                yield pa.RecordBatch.from_arrays([h, batch.column(0).take(one), batch.column(1).take(one), pos, *bytes_], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"h long, doc_id {kind}, tkey long, pos int, before binary, after binary")


def padded(rows: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = column_bytes(rows)
    size = np.minimum(np.diff(offsets), width)
    out = np.zeros((len(size), width), np.uint8)
    mask = np.arange(width) < size[:, None]
    out[mask] = data[(offsets[:-1, None] + np.arange(width))[mask]]
    return out, size


def common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(size_a, size_b))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(prefix, first, last) of the common-prefix intervals of sorted suffixes; lcp[i] is of i and i + 1."""
    stack: list[list[int]] = []
    for i, now in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > now:
            prefix, left = stack.pop()
            yield prefix, left, i
        if now and (not stack or stack[-1][0] < now):
            stack.append([now, left])


def extensions(before: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The longest common left extension of each row with any other; ``order`` sorts the rows."""
    s, n = before[order], size[order]
    near = common(s[1:], s[:-1], n[1:], n[:-1])
    best = np.zeros(len(s), np.int64)
    best[order[1:]] = near
    best[order[:-1]] = np.maximum(best[order[:-1]], near)
    return best


def tree_repeats(group: np.ndarray, before: pa.Array, after: pa.Array, length: int, short: int, seed: int) -> tuple[list[int], list[int], list[int]]:
    """Row, left extension and prefix of all occurrences of maximal repeats of ``short`` bytes or more. Rows are sorted by (group, after)."""
    a, size_a = padded(after, length)
    b, size_b = padded(before, length - seed)
    lcp = common(a[1:], a[:-1], size_a[1:], size_a[:-1])
    lcp[group[1:] != group[:-1]] = 0
    ext = common(b[1:], b[:-1], size_b[1:], size_b[:-1])
    rank = np.empty(len(b), np.int64)
    rank[np.argsort(b.view(f"S{b.shape[1]}").reshape(-1), kind="stable")] = np.arange(len(b))
    rows: list[int] = []
    lefts: list[int] = []
    prefixes: list[int] = []
    full = np.zeros(len(group), bool)  # rows that can't be extended further to the left
    near, least = ext.tolist(), short - (length - seed)
    for prefix, lo, hi in intervals(lcp.tolist()):
        if prefix < least:
            continue
        if hi == lo + 1:
            if prefix + near[lo] >= short:
                rows += (lo, hi)
                lefts += (near[lo], near[lo])
                prefixes += (prefix, prefix)
            continue
        if full[lo : hi + 1].all():
            continue
        best = extensions(b[lo : hi + 1], size_b[lo : hi + 1], np.argsort(rank[lo : hi + 1]))
        keep = np.flatnonzero((best + prefix >= short) & ~full[lo : hi + 1])
        rows += (keep + lo).tolist()
        lefts += best[keep].tolist()
        prefixes += [prefix] * len(keep)
        full[lo : hi + 1] |= best == size_b[lo : hi + 1]
    return rows, lefts, prefixes


def from_tree(contexts: DataFrame, length: int, short: int, seed: int) -> DataFrame:
    """doc_id, tkey, start, end of the occurrences that the interval trees give; contexts of one ``g`` are one array."""
    names = ["doc_id", "tkey", "start", "end"]

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = tree_repeats(batch.column(0).to_numpy(), batch.column(4), batch.column(5), length, short, seed)
        row, left, prefix = (np.array(x, np.int64) for x in found)
        pos, which = batch.column(3).to_numpy()[row], pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(1).take(which), batch.column(2).take(which), pa.array((pos - left).astype(np.int32)), pa.array((pos + prefix).astype(np.int32))], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that isn't over yet
        for batch in batches:
            if not len(batch):
                continue
            g = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()
            if held and held[0].column(0)[0].as_py() != g[0]:
                cuts.insert(0, 0)
            at = 0
            for k, c in enumerate(cuts):  # whole groups only, some 2000 rows at a time
                if held or c - at >= 2000 or k == len(cuts) - 1:
                    part = pa.Table.from_batches([*held, batch.slice(at, c - at)]).combine_chunks().to_batches()
                    held, at = [], c
                    yield from map(solve, part)
            held.append(batch.slice(at))
        if held:
            yield from map(solve, pa.Table.from_batches(held).combine_chunks().to_batches())

    kind = contexts.schema["doc_id"].dataType.simpleString()
    return contexts.select("g", "doc_id", "tkey", "pos", "before", "after").repartition("g").sortWithinPartitions("g", "after").mapInArrow(task, f"doc_id {kind}, tkey long, start int, end int")


def split(contexts: DataFrame, width: int, window: int, seed: int) -> DataFrame:
    """Places with the middles of their windows: one row for each ``width`` offsets at which a window of ``window`` bytes may start.

    ``g`` is the hash of what all those windows share, and ``first`` the place of the first of them: the
    whole of it where ``width`` is 1."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    names = ["g", "doc_id", "tkey", "pos", "before", "after", "h", "lead", "upto"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                before, after = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                p, low, high = len(before), batch.column(6)[k].as_py(), batch.column(7)[k].as_py()
                lead = np.arange(low, high, width)  # bytes of the left context
                tail = np.minimum(lead + width, high) - 1
                fits = (lead <= p) & (window - tail <= len(after))  # at least one of the windows lies within the text
                lead, tail = lead[fits], tail[fits]
                from_, to = p - np.minimum(lead, p), np.minimum(p - tail + window, p + len(after))
                text = Spans(np.frombuffer(before[::-1] + after, np.uint8))
                g = text.of(from_, to) + (lead + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                one = pa.array(np.full(len(lead), k))
                same = [batch.column(c).take(one) for c in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *same, pa.array(lead.astype(np.int32)), pa.array((tail + 1).astype(np.int32))], names)

    rows = contexts.select("doc_id", "tkey", "pos", "before", "after", "h", "lead", "upto").repartition("doc_id", "tkey", "pos")
    out = rows.mapInArrow(task, f"g long, doc_id {kind}, tkey long, pos int, before binary, after binary, h long, lead int, upto int")
    return out.withColumn("g", F.xxhash64("h", "g"))


def refined(contexts: DataFrame, length: int, short: int, seed: int, group: int) -> DataFrame | None:
    """The same for hashes of more than ``group`` kinds: trees over places that share a middle, and whole windows where that many share one."""
    found = None

    def add(rows: DataFrame) -> None:
        nonlocal found
        found = rows if found is None else found.unionByName(rows)

    for window in (short, length):
        width = window - seed + 1
        left = contexts.withColumn("lead", F.lit(0)).withColumn("upto", F.lit(width))
        while True:
            width = -(-width // PARTS)
            parts = written(split(left, width, window, seed), "middles")
            n = parts.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
            if width == 1:
                whole = parts.join(n.filter(F.col("n") > group), "g", "left_semi")
                add(whole.select("doc_id", "tkey", (F.col("pos") - F.col("lead")).alias("start"), (F.col("pos") - F.col("lead") + window).alias("end")))
                add(from_tree(parts.join(n.filter(F.col("n") <= group), "g", "left_semi"), length, short, seed))
                break
            add(from_tree(parts.join(n.filter(F.col("n") <= group), "g", "left_semi"), length, short, seed))
            left = parts.join(n.filter(F.col("n") > group), "g", "left_semi")
            if left.isEmpty():
                break
    return found


def occurrences(docs: DataFrame, length: int = LENGTH, short: int = SHORT, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Occurrences of repeats of ``short`` bytes or more: doc_id, tkey, start, end; those of ``length`` or more are as long here."""
    # made twice rather than kept: ten bytes of anchors for each hundred of text would be written and read
    again = anchor_rows(docs, length, short, seed).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = written(again, "repeated_hashes")  # a plain join after that: the rows of a hot hash can be split
    rows = written(anchor_rows(docs, length, short, seed).join(again, "h", "left_semi"), "repeated_anchors")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "pos", "before", "after")
    kinds = written(rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("at")), "surroundings")
    equal = rows.join(kinds.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    found = equal.select("doc_id", "tkey", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"))
    many = kinds.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    places = kinds.join(many, "h").select("h", "m", *(f"at.{c}" for c in ("doc_id", "tkey", "pos", "before", "after")))
    found = found.unionByName(from_tree(surroundings(docs, places.filter(F.col("m") <= group)).withColumnRenamed("h", "g"), length, short, seed))
    hot = places.filter(F.col("m") > group)
    if not hot.isEmpty():
        found = found.unionByName(refined(written(surroundings(docs, hot), "contexts"), length, short, seed, group))
    return found


_blank = np.zeros(256, bool)
_blank[list(b" \t\n\r\x0b\x0c")] = True


def covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mask of the bytes within any of the spans, which are cut to their texts."""
    edge = np.zeros(offsets[-1] + 1, np.int32)
    np.add.at(edge, offsets[doc] + start, 1)
    np.add.at(edge, np.minimum(offsets[doc] + end, offsets[doc + 1]), -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def masked_runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True within each text, and each text's first run (n + 1 places)."""
    starts, ends = runs(np.insert(mask, offsets[1:-1], False))  # a gap between texts
    gap = np.searchsorted(offsets[1:-1] + np.arange(len(offsets) - 2), starts, side="right")
    starts, ends = starts - gap, ends - gap
    return starts, ends, np.searchsorted(starts, offsets)


def removed(docs: DataFrame, length: int = LENGTH, short: int = SHORT, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, in bytes), kept (the remaining bytes) and passages (repeated runs of PASSAGE_WORDS or more)."""
    docs = picked(docs, "doc_id", "text")
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    spans = occurrences(docs, length, short, seed, group).groupBy("doc_id", "tkey").agg(F.collect_list(packed).alias("spans"))
    rows = with_text(docs, spans, "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "spans", "kept", "passages"]

    def lists(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> pa.Array:
        base = np.repeat(offsets[:-1], np.diff(first))
        both = pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (starts, ends)], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), both)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                text, some = data[offsets[i] : offsets[j]], batch.column(2).slice(i, j - i)
                n = np.nan_to_num(some.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                span = some.flatten().to_numpy()
                doc, start, end = np.repeat(np.arange(j - i), n), span >> 32, span & 0xFFFFFFFF
                long = np.minimum(end, np.diff(at)[doc]) - start >= length  # a text may end before its surroundings would
                gone, told = covered(doc[long], start[long], end[long], at), covered(doc, start, end, at)
                starts, ends, first = masked_runs(told, at)
                solid = ~_blank[text]
                inside = np.concatenate(([False], solid[:-1]))  # whether a word may go on from the byte before
                inside[at[:-1][at[:-1] < len(text)]] = False
                begins = np.concatenate(([0], np.cumsum(solid & ~inside)))
                enough = begins[ends] - begins[starts] >= PASSAGE_WORDS
                kept_runs = np.concatenate(([0], np.cumsum(enough)))
                passages = lists(starts[enough], ends[enough], kept_runs[first], at)
                left, size = text[~gone], np.concatenate(([0], np.cumsum(~gone)))[at]
                kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(left)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), lists(*masked_runs(gone, at), at), kept, passages], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    run = "array<struct<start:int,end:int>>"
    return rows.mapInArrow(task, f"doc_id {kind}, n_bytes long, spans {run}, kept binary, passages {run}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, a digest of the remaining bytes, and how many repeated passages of many words there are."""
    return removed(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"),
    )


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union within n bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def plain_runs(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """By brute force, for tests: each text's runs of bytes that a repeated string of ``length`` covers."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    return [merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1], len(t)) for t in texts]


def plain(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by brute force, for tests: n_bytes, n_removed, n_spans, digest."""
    return [(len(t), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept(t, gone)).hexdigest()) for t, gone in zip(texts, plain_runs(texts, length), strict=True)]
