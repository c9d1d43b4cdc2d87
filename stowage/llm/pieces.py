"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it came from."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import slices, table

#: Fixed values of the model format: types of a piece, and the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁".encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled map of byte sequences to replacements: a double-array trie and its strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that data has at a place."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        return found and (found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])])


class OffsetEncoder:
    """Encodes with a model's own library and projects each piece to bytes of the original text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        charsmap, self.prefix, self.squeeze, self.escape, suffix = b"", True, True, True, False
        types, pieces, self.marked = [], [], []
        for n, value in _fields(model):
            if n == 1:
                piece = dict(_fields(value))
                types.append(piece.get(3, NORMAL))
                pieces.append(piece[1])
            elif n == 2:
                suffix = bool(dict(_fields(value)).get(24, 0))
            elif n == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, self.squeeze, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.map, self.suffix = CharacterMap(charsmap), suffix
        self.marked = sorted((p for p, t in zip(pieces, types, strict=True) if t == USER_DEFINED), key=len, reverse=True)
        self.space = SPACE if self.escape else b" "
        # bytes of normalised text that a piece stands for; -1: the unknown piece, whose text tells
        self.size = np.array([0 if t == CONTROL else 1 if t == BYTE else -1 if t == UNKNOWN else len(p) for p, t in zip(pieces, types, strict=True)], np.int64)
        self.plain = not charsmap and not self.squeeze and not self.suffix and not self.marked

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in data it came from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, len(self.space), 1) if len(self.space) > 1 else np.ones(len(raw), np.int64)
            lead = len(self.space) if self.prefix else 0
            places = np.concatenate((np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]))
            return (self.space if self.prefix else b"") + data.replace(b" ", self.space), places
        out, places, at, end = bytearray(), [], 0, len(data)

        def prefix(at: int) -> tuple[int, bytes]:
            for mark in self.marked:
                if data.startswith(mark, at):
                    return len(mark), mark
            if got := self.map.longest(data, at):
                return got
            size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            return size, data[at : at + size]

        def put(text: bytes, place: int) -> None:
            out.extend(text)
            places.extend([place] * len(text))

        if self.squeeze:
            while at < end and (got := prefix(at))[1] == b" ":
                at += got[0]
        if at == end:
            return b"", np.array([at], np.int64)
        if self.prefix and not self.suffix:
            put(self.space, at)
        after_space = self.squeeze
        while at < end:
            size, text = prefix(at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", self.space), at)
                after_space = self.squeeze and text.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(self.space):
                at = places[-len(self.space)]
                del out[-len(self.space) :], places[-len(self.space) :]
        if self.prefix and self.suffix:
            put(self.space, at)
        return bytes(out), np.array([*places, at], np.int64)

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray | None, np.ndarray | None]:
        """Ids with begin and end, and first and last original byte of each; empty spans for control pieces and what was put in.

        Where pieces don't stand for the bytes of our own normalisation, the ids are given and no bytes.
        """
        text = text or ""
        ids = self.library.encode(text, out_type=int, add_bos=True, add_eos=True, num_threads=1)
        _, places = self.normalise(text.encode("utf-8", "surrogatepass"))
        sizes = self.size[np.array(ids, np.int64)]
        if (sizes < 0).any():
            surface = self.library.encode(text, out_type=str, add_bos=True, add_eos=True, num_threads=1)
            sizes = np.array([len(surface[i].encode()) if n < 0 else n for i, n in enumerate(sizes.tolist())], np.int64)
        ends = np.cumsum(sizes)
        if ends[-1] != len(places) - 1:
            return ids, None, None
        return ids, places[ends - sizes], places[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids, begins, ends) per row: piece i came from bytes begins[i] to ends[i] of the text in UTF-8.

    A null text encodes as an empty one, to the begin and end ids alone. Very long texts are encoded whole, in a slice of
    their own. begins and ends are null where pieces can't be aligned. Rows with null or repeated ids are
    encoded like any other; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder(model)
        for batch in batches:
            for part in slices(batch, rows=64):
                got = [encoder.encode(t) for t in part.column("text").to_pylist()]
                arrays = [pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "ids", "begins", "ends"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_covered) per row, without writing the ids out.

    n_covered counts the bytes of the text that some piece's span holds, null where pieces can't be aligned; else as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder(model)
        for batch in (part for batch in batches for part in slices(batch)):
            n, ids_sha, text_sha, size, covered = [], [], [], [], []
            for cell in batch.column("text"):
                text = cell.as_py() or ""
                ids, begins, ends = encoder.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                size.append(len(text.encode("utf-8", "surrogatepass")))
                covered.append(None if ends is None else int((ends - np.maximum(begins, np.concatenate(([0], np.maximum.accumulate(ends)[:-1])))).clip(0).sum()))
            arrays = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(size, pa.int64()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "n_covered"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_covered long")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding; null, empty and very long texts are as in encode()."""
    return digests(table(spark, sf_dir, "documents"), public_model())
