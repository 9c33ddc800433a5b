"""Quality rules: counted rules first, then a logistic regression on hashed n-grams.

The counted rules (:func:`counts`) look at one text alone. The model hashes a text's words, word
pairs and character n-grams into a fixed number of buckets; a family's feature is a bucket's share
of the family's n-grams, and the log-odds are a bias plus the families' mean weights.
It is trained on labelled rows, its output is calibrated on labelled rows kept aside for that
(Platt's sigmoid), and texts are scored in Arrow batches against a fixed threshold.

Training takes at most ``TRAIN_ROWS`` labelled rows of at most ``TRAIN_BYTES`` bytes each, chosen
by a hash of their id; every text is scored, whole.

Defined cases: a null text has no words and fails; equal labels only, or none, give a model that
keeps all that the counted rules keep; labels that are null or not 0 or 1 are left out;
repeated rows are each judged; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bytesops import Spans, chunks, column_bytes
from pricelode.llm.storage import aliased, picked, with_fields

BITS = 16
TRAIN_ROWS = 4000
TRAIN_BYTES = 50_000
THRESHOLD = 0.5
MIN_WORDS = 50
#: Families of n-grams: characters (bytes) 3 and 5 long, words, word pairs.
CHARS = (3, 5)
FAMILIES = len(CHARS) + 2
SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_is_space = np.zeros(256, bool)
_is_space[list(SPACE)] = True


def counts(data: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a UTF-8 text."""
    words = data.split()  # bytes split at exactly the six white-space bytes
    n = len(words)
    inside = data.translate(None, SPACE)
    chars = len(inside.decode())
    symbols = len(inside) - len(inside.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.translate(None, SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    threes = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(threes)) < len(threes):
        seen = Counter(threes)
        upto = 0
        for i, w in enumerate(threes):
            if seen[w] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, dup, repeat, n < MIN_WORDS or 100 * repeat > 50 * n


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: hashed n-grams of all texts, and each text's first one (n + 1 places)."""
    n, shift = len(data), np.uint64(64 - BITS)
    spans = Spans(data)
    for width in CHARS:
        hashed = (spans.every(width) >> shift).astype(np.int64)
        last = np.maximum(offsets[1:] - (width - 1), offsets[:-1])  # a text's n-grams end within it
        keep = np.zeros(n + 1, np.int64)
        np.add.at(keep, offsets[:-1], 1)
        np.add.at(keep, last, -1)
        inside = np.cumsum(keep[: len(hashed)]) > 0
        yield hashed[inside], np.concatenate(([0], np.cumsum(last - offsets[:-1])))
    blank = _is_space[data]
    edge = np.ones(n + 1, bool)
    edge[:-1] = blank
    begin = np.zeros(n, bool)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    opened = np.ones(n, bool)
    opened[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (opened | begin))
    ends = np.append(np.flatnonzero(edge), n)
    ends = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
    closes = offsets[np.searchsorted(offsets, starts, side="right")]
    ends = np.minimum(ends, closes)
    owner = np.searchsorted(starts, offsets)
    word = spans.of(starts, ends)
    yield (word >> shift).astype(np.int64), owner
    pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) >> shift
    pair[word[:-1] == word[1:]] = 0  # one bucket for any word that follows itself
    inside = np.ones(max(len(word) - 1, 0), bool)
    cut = owner[1:-1] - 1
    inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    yield pair[inside].astype(np.int64), np.concatenate(([0], np.cumsum(np.maximum(np.diff(owner) - 1, 0))))


def means(weight: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams; 0 without any."""
    total = np.concatenate(([0.0], np.cumsum(weight[hashed])))
    n = np.diff(first)
    return np.divide(total[first[1:]] - total[first[:-1]], n, out=np.zeros(len(n)), where=n > 0)


@dataclass
class Model:
    weight: np.ndarray  # families x buckets, float32
    bias: float
    slope: float = 1.0  # of the calibration
    shift: float = 0.0

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        for i, j in chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            if len(part):
                for f, (hashed, first) in enumerate(grams(part, offsets[i : j + 1] - offsets[i])):
                    z[i:j] += means(self.weight[f], hashed, first)
        return z

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(data, offsets) + self.shift, -40, 40)))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def shares_of(texts: list[bytes], at_once: int = 250) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct n-grams (numbered over all families) and their shares: slices of a few large arrays, which are given back whole."""
    rows = []
    for k in range(0, len(texts), at_once):
        ids, shares, size = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], []
        for t in texts[k : k + at_once]:
            data, offsets = joined([t])
            size.append(0)
            for f, (hashed, _) in enumerate(grams(data, offsets)) if len(data) else ():
                if len(hashed):
                    u, n = np.unique(hashed, return_counts=True)
                    ids.append((u + (f << BITS)).astype(np.int32))
                    shares.append((n / len(hashed)).astype(np.float32))
                    size[-1] += len(u)
        i, x, cut = np.concatenate(ids), np.concatenate(shares), np.cumsum([0, *size])
        rows += [(i[a:b], x[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return rows


def fit(texts: list[bytes], labels: list[int], epochs: int = 30, rate: float = 1.0) -> Model:
    """Adagrad on all rows' sparse shares; a fifth of the rows is kept for calibration."""
    y = np.array(labels, float)
    model = Model(np.zeros((FAMILIES, 1 << BITS), np.float32), 0.0)
    if not len(y) or y.min() == y.max():
        model.bias = 40.0
        return model
    aside = np.arange(len(texts)) % 5 == 4
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    rows = shares_of(texts)
    w = np.zeros(FAMILIES << BITS)
    g2 = np.full(FAMILIES << BITS, 1e-8)
    bias, b2 = 0.0, 1e-8
    part = np.where(y == 1, 0.5 / y[~aside].mean(), 0.5 / (1 - y[~aside].mean()))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~aside)):
            ids, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(bias + w[ids] @ x, -40, 40)))
            g = (p - y[i]) * part[i]
            if abs(g) > 1e-3:
                gx = g * x
                g2[ids] += gx * gx
                w[ids] -= rate * gx / np.sqrt(g2[ids])
                b2 += g * g
                bias -= 0.1 * g / np.sqrt(b2)
    model.weight, model.bias = w.reshape(FAMILIES, -1).astype(np.float32), bias
    check = np.flatnonzero(aside) if aside.any() else np.arange(len(texts))
    z = np.array([bias + w[rows[i][0]] @ rows[i][1] for i in check])
    model.slope, model.shift = platt(z, y[check])
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make a sigmoid of z a probability of y, with Platt's smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.array([1.0, 0.0])
    start, pull = x.copy(), np.array([1.0, 0.1])  # keeps the fit finite where the classes are apart

    def loss(x: np.ndarray) -> float:
        t = x[0] * z + x[1]
        return float((np.logaddexp(0, t) - target * t).sum() + (pull * (x - start) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x[0] * z + x[1], -40, 40)))
        d, v = p - target, p * (1 - p)
        h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + np.diag(pull)
        step = np.linalg.solve(h, np.array([(d * z).sum(), d.sum()]) + pull * (x - start))
        while abs(step).max() > 1e-9 and loss(x - step) > loss(x):
            step /= 2
        x = x - step
        if abs(step).max() < 1e-7:
            break
    return (float(x[0]), float(x[1])) if x[0] > 0 else (1.0, 0.0)


def sampled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, where=None) -> DataFrame:
    """text and label of a bounded sample (at most ``rows`` texts of ``most_bytes`` each), in a fixed order."""
    wanted = picked(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        wanted = wanted.filter(where)
    order = F.xxhash64("doc_id")
    chosen = wanted.groupBy("doc_id").agg(F.max("quality").alias("_label")).orderBy(order, "doc_id").limit(rows)
    found = picked(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= most_bytes)
    found = found.select(order.alias("_order"), "doc_id", "text", "_label").orderBy("_order", "doc_id", "text").limit(rows)
    return found.select("text", F.col("_label").alias("label"))


def train_split() -> object:
    """Rows that may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, fitted in one task on the bounded sample: the driver only gets its weights."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += [x.encode() for x in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        m = fit(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([m.weight.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.shift))], ["weight", "bias", "slope", "shift"])

    sample = sampled(docs, labels, where=train_split()).coalesce(1)
    found = sample.mapInArrow(task, "weight binary, bias double, slope double, shift double").collect()
    weight, *rest = found[0] if found else (b"", 40.0, 1.0, 0.0)
    return Model(np.frombuffer(bytes(weight) or bytes(4 * (FAMILIES << BITS)), np.float32).reshape(FAMILIES, -1), *rest)


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judged(frame: DataFrame, text: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``frame`` with the counts, the probability and the verdict on its column ``text``; its own names must not be of these."""
    sent = frame.sparkSession.sparkContext.broadcast(model)  # FAMILIES * 2**BITS floats, fixed
    at, added = frame.columns.index(text), [x.split()[0] for x in RESULT.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            p = sent.value.probability(data, offsets)
            whole = memoryview(data)
            rows = [counts(bytes(whole[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            failed = np.array(columns[5], bool)
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added])

    return frame.mapInArrow(task, with_fields(frame, RESULT))


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules and the model keep, with ``docs``' columns whatever their names."""
    frame, name = aliased(docs)
    return judged(frame, name["text"], trained(docs, labels)).filter("kept").select(*frame.columns).toDF(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(picked(docs, "doc_id", "text"), "text", trained(docs, labels)).drop("text")
