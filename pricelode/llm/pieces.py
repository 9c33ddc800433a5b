"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a whitespace marker after another character (checked when the
model is loaded), so no piece crosses from one marked word into the next: a text's ids are its
marked words' ids, one after another. Each task keeps a table of the distinct marked words
that it has met, segments each of them once with the library, and joins the ids back by position.
A table holds at most ``TABLE`` words; a full one is begun anew, which costs time and never
changes a result. Nothing is shuffled or broadcast.

Defined cases: a null text is empty; an empty text has the begin and end ids alone and decodes
to nothing; the marker character itself in a text is the same as a space, as in the library;
repeated rows are each encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricelode.llm.bytesops import column_bytes
from pricelode.llm.storage import aliased

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A run of markers and all that follows up to the next marker.
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
TABLE = 300_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """A model, and its table of distinct marked words: text -> ids (little-endian) -> decoded text."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker; words can't be segmented apart")
        if self.sp.decode(self.sp.encode(" a")) != " a" or self.sp.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("this model strips or doesn't mark leading spaces")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.ids: dict[str, bytes] = {}
        self.texts: dict[bytes, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Segment words that the table lacks, each once."""
        if len(self.ids) + len(chunks) > TABLE:
            self.ids.clear()
            self.texts.clear()
        new = [c for c in chunks if c not in self.ids]
        plain = [c[1:].replace(MARK, " ") for c in new]  # the library puts one marker in front
        for chunk, text, ids in zip(new, plain, self.sp.encode(plain, num_threads=1), strict=True):
            ids = ids or [self.sp.piece_to_id(MARK)]
            key = np.array(ids, "<u4").tobytes()
            self.ids[chunk] = key
            if key not in self.texts:
                self.texts[key] = b" " + self.sp.decode(ids).encode()

    def encode(self, text: str) -> list[bytes]:
        """Ids of each marked word of a text."""
        if not text:
            return []
        chunks = CHUNKS.findall(MARK + text.replace(" ", MARK))
        try:
            return list(map(self.ids.__getitem__, chunks))
        except KeyError:
            self.learn(set(chunks))
            return list(map(self.ids.__getitem__, chunks))

    def decode(self, words: list[bytes]) -> bytes:
        """The text of ids that stand in marked words; the first word's space was the library's."""
        return b"".join(map(self.texts.__getitem__, words))[1:]


def per_text(docs: DataFrame, path: str, fields: list[tuple[str, pa.DataType]], make: Callable[[Codec, list[bytes]], tuple], schema: str, keep: list[str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append(make(codec, codec.encode(data[a:b].tobytes().decode())))
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [*batch.schema.names[1:], *(n for n, _ in fields)])

    frame, name = aliased(docs)
    frame = frame.select(frame[name["text"]].alias("_text"), *(frame[name[c]].alias(c) for c in keep))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[1:])
    return frame.mapInArrow(task, f"{kept}, {schema}" if kept else schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (with begin and end) and the decoded text."""

    def make(codec: Codec, words: list[bytes]) -> tuple:
        ids = np.frombuffer(codec.begin + b"".join(words) + codec.end, "<u4")
        return ids.astype(np.int32), codec.decode(words).decode()

    return per_text(docs, path or model_path(), [("ids", pa.list_(pa.int32())), ("decoded", pa.string())], make, "ids array<int>, decoded string", ["doc_id"])


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""

    def make(codec: Codec, words: list[bytes]) -> tuple:
        ids = codec.begin + b"".join(words) + codec.end
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(words)).hexdigest()

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return per_text(docs, path or model_path(), fields, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Texts of any ids (doc_id, ids), by the library itself: for ids that come without their words."""
    path = path or model_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts = [sp.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(task, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, decoded string")
