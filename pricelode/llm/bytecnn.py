"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are laid out in chunks of ``CHUNK`` that overlap by ``OVERLAP``, so that they
cover all of it and no filter's window is lost at a seam. Bytes are embedded, ``FILTERS``
learned filters of ``WIDTH`` bytes slide by ``STEP``, each filter's largest answer in a chunk
stays (max pooling), and the mean and the maximum over the chunks go into one probability.

Training takes at most ``TRAIN_ROWS`` labelled rows of at most ``TRAIN_BYTES`` bytes, chosen by
a hash of their id, from the rows that may be learnt from; every text is scored, whole.

Defined cases: a null or empty text is one chunk of padding and gets a score too; without
labels of both kinds all scores are that kind's share (1 without any); repeated rows are each
scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bytesops import column_bytes
from pricelode.llm.ngramlr import joined, sampled, train_split
from pricelode.llm.storage import aliased

CHUNK, OVERLAP = 512, 64
WIDTH, STEP, FILTERS, DIM = 8, 2, 32, 8
PAD = 256
TRAIN_ROWS = 3000
TRAIN_BYTES = 50_000
THRESHOLD = 0.7
#: Chunks that are convolved together: the temporaries stay in the processor's cache.
AT_ONCE = 64
CELLS = CHUNK // WIDTH


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all chunks, and each text's first chunk (n + 1 places)."""
    size = np.diff(offsets)
    hop = CHUNK - OVERLAP
    n = np.maximum(1, -(-(size - OVERLAP) // hop))
    first = np.concatenate(([0], np.cumsum(n)))
    nth = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(offsets[:-1], n) + nth * hop, first


def chunk_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of chunks, padded after their text's end."""
    at = start[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.full(at.shape, PAD, np.int64)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)].astype(np.int64), PAD)


@dataclass
class Network:
    embed: np.ndarray  # 257 x DIM; the padding's row is 0
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float

    def pooled(self, cells: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest answer of each filter in each chunk (chunks x FILTERS), and its place."""
        n = len(cells)
        flat = np.concatenate([self.embed[cells].reshape(-1), np.zeros(WIDTH * DIM, np.float32)])
        best, place = None, None
        for phase in range(0, WIDTH, STEP):
            rows = flat[phase * DIM : phase * DIM + n * CELLS * WIDTH * DIM].reshape(n * CELLS, WIDTH * DIM)
            answer = (rows @ self.filters).reshape(n, CELLS, FILTERS)
            answer = answer[:, : CELLS - 1] if phase else answer  # the last window runs into the next chunk
            if where:
                k = answer.argmax(axis=1)
                top = np.take_along_axis(answer, k[:, None], 1)[:, 0]
                k = k * WIDTH + phase
            else:
                top = answer.max(axis=1)
            if best is None:
                best, place = top, k if where else None
            elif where:
                place = np.where(top > best, k, place)
                best = np.maximum(best, top)
            else:
                np.maximum(best, top, out=best)
        return np.maximum(best + self.bias, 0), place

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start, first = laid_out(data, offsets)
        end = np.repeat(offsets[1:], np.diff(first))
        total = np.empty((len(start), FILTERS), np.float32)
        for i in range(0, len(start), AT_ONCE):
            total[i : i + AT_ONCE], _ = self.pooled(chunk_bytes(data, start[i : i + AT_ONCE], end[i : i + AT_ONCE]))
        if not len(offsets) - 1:
            return np.zeros(0)
        mean = np.add.reduceat(total, first[:-1], axis=0, dtype=np.float64) / np.diff(first)[:, None]
        top = np.maximum.reduceat(total, first[:-1], axis=0)
        z = np.concatenate([mean, top], axis=1) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def untrained(seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (257, DIM)).astype(np.float32)
    embed[PAD] = 0
    filters = rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
    return Network(embed, filters, np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)


def fit(texts: list[bytes], labels: list[int], steps: int = 1100, rate: float = 0.01, batch: int = 16) -> Network:
    """Adam on the balanced log loss, texts of like length together, for ``steps`` batches or a little more."""
    net, y = untrained(), np.array(labels, float)
    if not len(y) or y.min() == y.max():
        net.shift = 30.0 if not len(y) or y[0] else -30.0
        return net
    part = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(5)
    size = np.array([len(t) for t in texts])
    params = [net.embed, net.filters, net.bias, net.out, np.zeros(1)]
    one, two = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    epochs = -(-steps // -(-len(texts) // batch))
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = np.argsort(size * rng.uniform(0.8, 1.25, len(size)))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            pick = groups[g]
            grads = gradients(net, [texts[i] for i in pick], y[pick], part[pick], float(params[4][0]))
            step += 1
            speed = rate * (1 - 0.9 * step / total)
            for p, d, m, v in zip(params, grads, one, two, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
            net.embed[PAD] = 0
    net.shift = float(params[4][0])
    return net


def gradients(net: Network, texts: list[bytes], y: np.ndarray, part: np.ndarray, shift: float) -> list[np.ndarray]:
    data, offsets = joined(texts)
    start, first = laid_out(data, offsets)
    n = np.diff(first)
    cells = chunk_bytes(data, start, np.repeat(offsets[1:], n))
    pooled, place = net.pooled(cells, where=True)
    mean = np.add.reduceat(pooled, first[:-1], axis=0) / n[:, None]
    top = np.maximum.reduceat(pooled, first[:-1], axis=0)
    x = np.concatenate([mean, top], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ net.out + shift, -30, 30)))
    g = (p - y) * part / len(texts)
    d_out = x.T @ g + 1e-4 * net.out
    dx = g[:, None] * net.out
    owner = np.repeat(np.arange(len(texts)), n)
    tied = (pooled == top[owner]).astype(np.float64)  # equal chunks share the gradient of their maximum
    tied /= np.add.reduceat(tied, first[:-1], axis=0)[owner]
    d = dx[owner, :FILTERS] / n[owner][:, None] + dx[owner, FILTERS:] * tied
    d *= pooled > 0
    chunk, kernel = np.nonzero(d)
    value = d[chunk, kernel].astype(np.float32)
    at = place[chunk, kernel][:, None] + np.arange(WIDTH)
    got = cells[chunk[:, None], at]
    window = net.embed[got].reshape(len(chunk), WIDTH * DIM) * value[:, None]
    d_filters = np.zeros_like(net.filters.T)
    np.add.at(d_filters, kernel, window)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, got.reshape(-1), (net.filters.T[kernel] * value[:, None]).reshape(-1, DIM))
    return [d_embed, d_filters.T, d.sum(axis=0), d_out, np.array([g.sum()])]


def trained(docs: DataFrame, labels: DataFrame) -> Network:
    """The network, fitted in one task on the bounded sample: the driver only gets its weights."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += [x.encode() for x in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, y))], pa.binary())], ["net"])

    found = sampled(docs, labels, TRAIN_ROWS, TRAIN_BYTES, where=train_split()).coalesce(1).mapInArrow(task, "net binary").first()
    return pickle.loads(bytes(found["net"])) if found else fit([], [])


def scored(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """``docs``' columns ``keep`` with a score; one pass, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.scores(*column_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], [*batch.schema.names[1:], "score"])

    frame, name = aliased(docs)
    frame = frame.select(frame[name["text"]].alias("_text"), *(frame[name[c]].alias(c) for c in keep))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[1:])
    return frame.mapInArrow(task, f"{kept}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return scored(docs, trained(docs, labels), ["doc_id"]).select(
        "doc_id", (~F.coalesce(train_split(), F.lit(True))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
