"""Near-duplicate documents by DartMinHash signatures, banded joins and checked links.

A text is the multiset of its shingles (five consecutive lower-cased words; a shorter text is one
shingle of all its words). Similarity is the weighted Jaccard similarity of these multisets, and a
link is a pair of ``SIMILARITY`` or more. Classes are the connected components of the links.

Signatures: darts are thrown into the regions of weighted elements (element x weight x rank) by
a hash, so that every text with an element sees the same darts there. A region of area one holds
a Poisson number of them. Each dart falls on one of ``COORDINATES`` coordinates, and a text keeps the
dart of the least rank on each; two texts agree on a coordinate with their similarity as the
probability. A text of total weight W looks at ranks up to (k ln k + 2 k) / W, and further
where a coordinate is still empty, so the work follows the darts, not elements times coordinates.

Candidates: texts that agree on all ``ROWS`` coordinates of one of ``BANDS`` bands meet in a bucket
(at 0.8 a pair misses all of them with a probability of 3e-6). Equal multisets are one node before
that. A bucket's hub is the member that meets most others over all bands: the base of a family of
copies. Each text is compared with each of its buckets' hubs, on the whole texts, and keeps its
delta to it: the elements that only one of the two has. Those links give most classes. Two texts of one
bucket then are of one class, or one of them is a stranger to its hub's class; strangers are settled against all
texts of the hub by their deltas alone, which say exactly how much two texts share (:func:`linked_strangers`). So every
pair of a bucket is settled, no pair is ever a row, and the rows are texts times their hubs.

Defined cases: null, empty and wordless texts are near duplicates of nothing (each its own class);
rows with one doc_id and one text are one document, and :func:`deduped` keeps one of them; documents
without an id may be grouped, and stay only if no member has an id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bytesops import IN_WORD, LOWER, Spans, chunks, column_bytes, mix, solid_spans, take_spans
from pricelode.llm.storage import aliased, picked, written

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 256
ROWS = 6
BANDS = COORDINATES // ROWS
#: Deltas that meet in one task at once, on either side; more of one hub are dealt to more blocks.
BLOCK_BYTES = 4 << 20

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FULL = COORDINATES * (np.log(COORDINATES) + 2)


def _poisson() -> np.ndarray:
    """Darts in a region of area one, by 16 bits of its hash."""
    p, total, cuts = np.exp(-1.0), 0.0, []
    for n in range(1, 10):
        total += p
        cuts.append(total * 65536)
        p /= n
    return np.searchsorted(cuts, np.arange(65536), side="right").astype(np.int64)


_DARTS = _poisson()


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles, and each text's first one (n + 1 places)."""
    lower = LOWER[data]
    starts, ends, first = solid_spans(IN_WORD[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = Spans(lower).of(starts, ends)
    n = np.diff(first)
    size = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = take_spans(first[:-1], size)
    doc = np.repeat(np.arange(len(n)), size)
    have = np.minimum(n[doc], width)
    out = np.zeros(len(begin), np.uint64)
    last = len(word) - 1
    for k in range(width):
        step = mix(out * _K1 + word[np.minimum(begin + k, last)] + np.uint64(k + 1))
        out = step if n.min(initial=width) >= width else np.where(have > k, step, out)
    return out, np.concatenate(([0], np.cumsum(size)))


def elements(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Unit-weight elements of each text, sorted: the j-th of equal shingles is the element (shingle, j)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashed = hashed[np.lexsort((hashed, doc))]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(hashed))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mix(hashed + nth.astype(np.uint64) * _K2), hashed)


def throw(own: np.ndarray, doc: np.ndarray, rank: np.ndarray, best: np.ndarray) -> None:
    """Darts of the regions (element, rank cell); the least per text and coordinate goes to ``best``."""
    cell = mix(own ^ ((rank + 1).astype(np.uint64) * _K3))
    n = _DARTS[(cell >> np.uint64(48)).astype(np.int64)]
    which = np.repeat(np.arange(len(cell)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix(cell[which] + (nth + 1).astype(np.uint64) * _K1)
    place = (dart >> np.uint64(65 - COORDINATES.bit_length())).astype(np.int64)  # COORDINATES is a power of two
    low = dart & np.uint64(0xFFFFFFFF)
    fine = (mix(dart) >> np.uint64(44)) | (rank[which].astype(np.uint64) << np.uint64(20))
    np.minimum.at(best.reshape(-1), doc[which] * COORDINATES + place, (fine << np.uint64(32)) | low)


def signatures(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts x coordinates: the dart of the least rank on each; all ones for a text without shingles."""
    size = np.diff(first)
    best = np.full((len(size), COORDINATES), _NONE, np.uint64)
    done = np.zeros(len(size), np.int64)
    upto = np.ceil(_FULL / np.maximum(size, 1)).astype(np.int64)
    todo = np.flatnonzero(size)
    while len(todo):
        cells = size[todo] * (upto[todo] - done[todo])
        stop = np.cumsum(cells)
        at = 0
        while at < len(todo):  # bounded pieces
            to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + (1 << 18), side="right")))
            part = todo[at:to]
            each = take_spans(first[part], size[part])
            doc = np.repeat(part, size[part])
            deep = upto[doc] - done[doc]
            rank = take_spans(done[doc], deep)
            throw(np.repeat(own[each], deep), np.repeat(doc, deep), rank, best)
            at = to
        done[todo] = upto[todo]
        todo = todo[(best[todo] == _NONE).any(axis=1)]
        upto[todo] *= 2
    return best


def bands(best: np.ndarray) -> np.ndarray:
    """Texts x bands: a hash of each band's coordinates (and of the band's number)."""
    rows = best[:, : BANDS * ROWS].reshape(len(best), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _K2, rows.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _K1 + rows[:, :, k])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (tells texts of one id apart), h1 and h2 (of the multiset), n shingles, bands."""
    names = ["doc_id", "tkey", "h1", "h2", "n", "bands"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in chunks(offsets):
                hashed, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = elements(hashed, first)
                total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own ^ k), dtype=np.uint64))) for k in (_K1, _K3)]
                h1, h2 = (pa.array((t[first[1:]] - t[first[:-1]]).view(np.int64)) for t in total)
                key = bands(signatures(own, first)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS, dtype=np.int32)), pa.array(key.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), h1, h2, pa.array(np.diff(first)), lists], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(task, f"doc_id {kind}, tkey long, h1 long, h2 long, n long, bands array<long>")


def candidate_elements(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted elements, for ``nodes`` (node, first_id, h1, h2)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            a, b = (batch.column(k).to_numpy() for k in (2, 3))
            for i, j in chunks(offsets):
                hashed, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = elements(hashed, first)
                keep, out = [], []
                for d in range(j - i):
                    mine = np.sort(own[first[d] : first[d + 1]])
                    if [int(mix(mine ^ k).sum(dtype=np.uint64)) for k in (_K1, _K3)] == [int(x) & (2**64 - 1) for x in (a[i + d], b[i + d])]:
                        keep.append(i + d)
                        out.append(mine.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["node", "own"])

    wanted = nodes.select(F.col("first_id").alias("_id"), F.col("tkey").alias("_key"), "node", "h1", "h2")
    rows = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    return rows.select("text", "node", "h1", "h2").mapInArrow(task, "node long, own binary").dropDuplicates(["node"])


def alike(total: np.ndarray | int, differ: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    """Whether texts of ``total`` elements together, ``differ`` of them in one alone, are similar enough."""
    shared = (total - differ) / 2
    return shared >= similarity * (total - shared)


def compared(pairs: DataFrame, own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) with a's size, whether they are similar enough, and delta: the sorted elements that only one of them has."""
    names = ["a", "b", "size", "similar", "delta"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, similar, delta = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                d = np.setxor1d(x, y, assume_unique=True)
                size.append(len(x))
                similar.append(bool(alike(len(x) + len(y), len(d), similarity)))
                delta.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(similar, pa.bool_()), pa.array(delta, pa.binary())], names)

    left, right = own.select(F.col("node").alias("a"), F.col("own").alias("own_a")), own.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "own_a", "own_b").mapInArrow(task, "a long, b long, size long, similar boolean, delta binary")


def settled(table: DataFrame) -> bool:
    """Whether no label of the table changed in the last step."""
    return not table.agg(F.coalesce(F.max(F.col("label") != F.col("was")), F.lit(False))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes: the least node that each can reach. Labels jump, so rounds are few."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label")).withColumnRenamed("a", "node")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = written(nearer.join(jump, "label", "left").select("node", "was", F.coalesce("jump", "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if settled(new):
            return labels


class Group:
    """The strangers of one block: texts that aren't of their hub's class, by what sets them apart from it."""

    def __init__(self) -> None:
        self.size: list[int] = []
        self.label: list[int] = []
        self.delta: list[np.ndarray] = []
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def merged(self, batch: pa.RecordBatch, similarity: float) -> list[tuple[int, int]]:
        """Labels that links between the strangers and the members in ``batch`` join; a link within a class gives none."""
        size, label = batch.column("size").to_numpy(), batch.column("label").to_numpy()
        data, offsets = column_bytes(batch.column("delta"))
        element, first = data.view(np.uint64), offsets // 8
        own = np.diff(first)
        owner = np.repeat(np.arange(len(size)), own)
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        classes, nth = np.unique(label, return_inverse=True)
        out = []
        for k in range(len(self.size)):
            mine = self.root(self.label[k])
            other = np.array([self.root(x) != mine for x in classes.tolist()])
            if not other.any():
                continue
            lo, hi = np.searchsorted(element, self.delta[k]), np.searchsorted(element, self.delta[k], side="right")
            shared = np.bincount(owner[take_spans(lo, hi - lo)], minlength=len(size))
            close = alike(size + self.size[k], len(self.delta[k]) + own - 2 * shared, similarity) & other[nth]
            for x in np.unique(label[close]).tolist():
                a, b = self.root(x), self.root(mine)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    out.append((min(a, b), max(a, b)))
        return out


def linked_strangers(known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): labels to be joined, from ``known``: texts a with hub b, size, delta, and the labels of both.

    Two texts with one hub differ in exactly what their deltas differ in. Where their labels differ, one of them is a
    stranger to the hub's class. So a hub's strangers meet all its texts, blocks of strangers against blocks of texts,
    each of at most about ``BLOCK_BYTES`` of deltas; only labels that a link joins leave a block.
    """
    strange = F.col("label") != F.col("hub_label")
    each = F.octet_length("delta") + 64
    hubs = known.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.when(strange, each).otherwise(0)).alias("s"), F.sum(each).alias("m")).filter("n > 1 and s > 0")
    hubs = hubs.select("b", F.ceil(F.col("s") / BLOCK_BYTES).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK_BYTES).cast("int").alias("columns"))
    dealt = known.join(hubs, "b")
    at = F.xxhash64("a")
    block, salt = F.pmod(at, F.col("rows")).cast("int"), F.pmod(at, F.col("columns")).cast("int")
    strangers = dealt.filter(strange).select("b", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("salt"), F.lit(0).alias("role"), "size", "label", "delta")
    members = dealt.select("b", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("block"), salt.alias("salt"), F.lit(1).alias("role"), "size", "label", "delta")
    place = ["b", "block", "salt"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, Group()
        for batch in batches:
            where = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out: list[tuple[int, int]] = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                here = tuple(where[:3, i].tolist())
                if here != now:
                    now, group = here, Group()
                part = batch.slice(i, j - i)
                if where[3, i] == 0:
                    group.size += part.column("size").to_pylist()
                    group.label += part.column("label").to_pylist()
                    group.delta += [np.frombuffer(x.as_py(), np.uint64) for x in part.column("delta")]
                else:
                    out += group.merged(part, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    both = strangers.unionByName(members).repartition(*place).sortWithinPartitions(*place, "role")
    return both.mapInArrow(task, "a long, b long").distinct()


def linked(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the nodes that share a bucket with another."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(rows.join(shared, "key"), "met")
    # the member that meets most others over all bands is a bucket's hub: the base of a family of copies
    pop = met.groupBy("node").agg(F.sum("n").alias("pop"))
    best = F.max(F.struct("pop", (-F.col("node")).alias("neg")))
    hubs = met.join(pop, "node").groupBy("key").agg(best.alias("hub")).select("key", (-F.col("hub.neg")).alias("b"))
    pairs = written(met.join(hubs, "key").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    own = written(candidate_elements(docs, nodes.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")), "elements")
    found = written(compared(pairs.filter("a != b"), own, similarity), "compared")
    near = components(found.filter("similar").select("a", "b"))
    labels = written(pairs.select(F.col("a").alias("node")).distinct().join(near, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    # what is not of its hub's class may still be linked to another text of that hub
    known = found.join(labels.withColumnRenamed("node", "a"), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("hub_label")), "b")
    merged = components(linked_strangers(known, similarity)).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    return written(labels.join(merged, "label", "left").select("node", F.coalesce("whole", "label").alias("label")), "labels")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tkey, class_id (the least id of the class), class_size and keep, one row per document."""
    docs = picked(docs, "doc_id", "text")
    sketch = written(sketches(docs), "sketches")
    whole = sketch.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.min_by("tkey", F.struct(F.col("doc_id").isNull(), "doc_id", "tkey")).alias("tkey"), F.count("*").alias("copies"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    nodes = written(whole.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = linked(docs, nodes, similarity)
    slim = nodes.select("h1", "h2", "node", "first_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = slim.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = slim.join(of, "label").select("h1", "h2", "class_id", "class_size")
    out = sketch.select("doc_id", "tkey", "h1", "h2", "n").join(named, ["h1", "h2"], "left")
    alone = F.col("n") == 0
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "tkey", class_id.alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), class_id.eqNullSafe(F.col("doc_id")).alias("keep"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).drop("tkey")


def deduped(docs: DataFrame) -> DataFrame:
    """One document of each class: the one of the least id. ``docs``' columns are carried through whatever their names."""
    frame, name = aliased(docs)
    doc_id, text = name["doc_id"], name["text"]
    slim = frame.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = classes(slim).filter("keep").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")).distinct()
    rows = frame.withColumn("_own", F.xxhash64(text))
    rows = rows.join(kept.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tkey")), "left_semi")
    return rows.dropDuplicates([doc_id, "_own"]).select(*frame.columns).toDF(*docs.columns)
