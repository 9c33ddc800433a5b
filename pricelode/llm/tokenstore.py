"""Token ids in a binary store: segments of range-coded, checksummed blocks in doc_id order.

Writing: documents are range-partitioned and sorted by (doc_id, text hash), so one key with very
many rows is still split; each task encodes its documents with the tokenizers library, appends the
end id to each, and closes a segment every ``SEGMENT`` ids. A segment is one row of a Parquet
table (any file system that Spark knows): the part and number of the segment, the ids before it in its part,
its documents with their id counts, and the payload of :mod:`rangecoder`. Ids are never collected.

Reading: segments are decoded where they lie; the ids before a part come from one row per part.

Encoding cuts texts where the tokenizer's pattern always cuts: where white space begins, after an ASCII letter
that something else of ASCII follows, and after a line feed that stands alone. Its merges never leave a cut piece, so a text's ids are its chunks' ids in order. The cuts, the
distinct chunks of a batch and the joining of their ids are array operations; a chunk is merged by the library's model once,
while it is in the worker's table. Texts that hold an added token's string go through the library whole.

Defined cases: a null text is empty and has the end id alone; repeated rows are stored each; rows without an
id come first; ids must be below 2**17; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.bytesops import column_bytes
from pricelode.llm.rangecoder import decode_blocks, encode_blocks
from pricelode.llm.storage import new_path, picked

TOKENIZER = "byte_bpe_50k.json"
END = 0
SEGMENT = 4 << 20
#: Chunks, and bytes of them, that a table holds at most before a batch; bytes of text that are encoded together.
TABLE, TABLE_BYTES, BATCH = 1_000_000, 64 << 20, 8 << 20

#: White space of the tokenizer's pattern (Unicode's White_Space), and that pattern; fixed values.
WHITE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters (with a space before) that are one piece of the pattern.
SIMPLE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")

SPACES = re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001))))
#: Kinds of bytes: 0 other ASCII, 1 white space, 2 letter, 3 part of a longer character; and whether texts are cut between two kinds.
KIND = np.array([1 if chr(b) in SPACES and b < 128 else 2 if chr(b).isalpha() and b < 128 else 3 * (b > 127) for b in range(256)], np.uint8)
CUT = np.zeros(16, bool)
CUT[[0 * 4 + 1, 2 * 4 + 1, 3 * 4 + 1, 2 * 4 + 0]] = True
#: White space of two and of three bytes: no cut between it and more of it.
WIDE = [np.array([int.from_bytes(c.encode()) for c in SPACES if len(c.encode()) == n]) for n in (2, 3)]


def chunk_starts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts; texts that are marked as whole are one chunk."""
    kind = KIND[data]
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = CUT[kind[:-1] * 4 + kind[1:]]
    after = np.flatnonzero(mark[1:-1] & (kind[:-1] == 3)) + 1
    if len(after):
        last = [data[np.maximum(after - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        pair = last[1] << 8 | last[0]
        mark[after[np.isin(pair, WIDE[0]) | np.isin(last[2] << 16 | pair, WIDE[1])]] = False
    line = np.flatnonzero(data[1:-1] == 10) + 1
    around = (kind[line - 1] % 2 == 0) & (kind[line + 1] % 2 == 0)
    mark[line[around] + 1] = True
    for k in np.flatnonzero(whole):
        mark[offsets[k] : offsets[k + 1]] = False
    mark[offsets] = True
    return np.flatnonzero(mark[:-1])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """The tokenizer with its table of chunks; kept by a Python worker from one task to the next."""

    kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.pattern = regex.compile(PATTERN.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]").replace(f"[^[{WHITE}]", f"[^{WHITE}"))
        self.letters = byte_letters()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, int] = {}
        self.ids, self.stops, self.held = array("I"), array("q", [0]), 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def merged(self, chunk: str) -> list[int]:
        """A chunk's ids, its pieces merged by the library's model."""
        if SIMPLE.fullmatch(chunk):
            mapped = [chunk.replace(" ", self.letters[32]) if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)]
        elif any(a in chunk for a in self.added):
            return self.whole.encode(chunk, add_special_tokens=False).ids
        else:
            mapped = [p.encode().decode("latin-1").translate(self.letters) for p in self.pattern.findall(chunk)]
        return [t.id for m in mapped for t in self.merge(m)]

    def places(self, chunks: list[bytes]) -> np.ndarray:
        """Where distinct chunks stand in the table; new ones are merged by the library's model and put there."""
        if len(self.table) > TABLE or self.held > TABLE_BYTES:
            self.clear()
        found = np.array(list(map(self.table.get, chunks, repeat(-1))), np.int64)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new = [chunks[k] for k in lacking.tolist()]
            found[lacking] = np.arange(len(self.table), len(self.table) + len(new))
            self.table.update(zip(new, found[lacking].tolist(), strict=True))
            for c in new:
                self.ids.extend(self.merged(c.decode()))
                self.stops.append(len(self.ids))
            self.held += sum(map(len, new))
        return found

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose UTF-8 bytes lie between these offsets, one after another, and how many each has."""
        data, offsets = np.ascontiguousarray(data[offsets[0] : offsets[-1]]), np.asarray(offsets, np.int64) - offsets[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        whole = np.zeros(len(texts), bool)
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        starts = chunk_starts(data, offsets, whole)
        ends = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        place = self.places(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())[chunks.indices.to_numpy()]
        ids, stops = np.array(self.ids, "<u4"), np.array(self.stops)
        n = np.diff(stops)[place]
        stop = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(stops[place] - stop[:-1], n)
        at += np.arange(len(at))
        return ids[at], np.diff(stop[np.searchsorted(starts, offsets)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_batch(data, np.array([0, len(data)]))[0].tobytes()


def write(docs: DataFrame, path: str, tokenizer: str | None = None, segment: int = SEGMENT) -> None:
    """Encode ``docs`` (doc_id, text) into the store at ``path``."""
    tokenizer = tokenizer or tokenizer_path()
    names = ["part", "segment", "before", "doc_ids", "counts", "payload"]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        doc_ids, counts, held, size, number, before = [], [], [], 0, 0, 0
        kind = None

        def closed() -> pa.RecordBatch:
            owners = pa.array([pa.concat_arrays(doc_ids)], pa.list_(kind))
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), owners, pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([encode_blocks(np.concatenate(held))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.column(0).type
            data, offsets = column_bytes(batch.column(1))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH, side="right")) - 1)
                ids, n = encoder.encode_batch(data, offsets[a : b + 1])
                ids, stop = np.insert(ids, np.cumsum(n), END), np.cumsum(n + 1)
                first = 0
                while first < b - a:
                    done = int(stop[first - 1]) if first else 0
                    last = min(int(np.searchsorted(stop, done + segment - size)), b - a - 1)  # the document that fills the segment
                    doc_ids.append(batch.column(0).slice(a + first, last + 1 - first))
                    counts.append(n[first : last + 1] + 1)
                    held.append(ids[done : stop[last]])
                    size += len(held[-1])
                    first = last + 1
                    if size >= segment:
                        yield closed()
                        number, before = number + 1, before + size
                        doc_ids, counts, held, size = [], [], [], 0
                a = b
        if doc_ids:
            yield closed()

    ordered = picked(docs, "doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    ordered.mapInArrow(task, f"part int, segment int, before long, doc_ids array<{id_type}>, counts array<long>, payload binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decoded(store: DataFrame, fields: str, make) -> DataFrame:
    """Per document: part, doc_id, the ids before it in its part, and what make(ids) gives."""
    names = ["part", "doc_id", "offset", *(f.split()[0] for f in fields.split(", "))]
    id_type = store.schema["doc_ids"].dataType.elementType.simpleString()
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = decode_blocks(batch.column(5)[k].as_py())
                counts = np.array(batch.column(4)[k].as_py(), np.int64)
                stop = np.cumsum(counts)
                first = stop - counts
                rows = [make(ids[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                columns = [pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), fields.split(", "), strict=True)]
                part = pa.array(np.full(len(rows), batch.column(0)[k].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([part, batch.column(3)[k].values, pa.array(first + batch.column(2)[k].as_py()), *columns], names)

    frame = store.select("part", "segment", "before", "doc_ids", "counts", "payload")
    return frame.mapInArrow(task, f"part int, doc_id {id_type}, offset long, {fields}")


def parts(store: DataFrame) -> DataFrame:
    """part and the ids before it: one small row for each partition of the writing job, summed up on the driver."""
    per = store.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    rows, total = [], 0
    for r in per:
        rows.append((r["part"], total))
        total += r["n"]
    return store.sparkSession.createDataFrame(rows, "part int, base long")


def ids(store: DataFrame) -> DataFrame:
    """doc_id and its ids, from the store."""
    return decoded(store, "ids array<int>", lambda x: (x.astype(np.int32),)).select("doc_id", "ids")


def report(docs: DataFrame) -> DataFrame:
    """Write the store, read it back: doc_id, start, n_tokens and a checksum of the ids."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path)
    store = read(spark, path)
    rows = decoded(store, "n_tokens long, ids_crc32 long", lambda x: (len(x), zlib.crc32(x.tobytes())))
    return rows.join(F.broadcast(parts(store)), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
