"""SentencePiece encoding that keeps the way back to the original bytes.

Normalisation runs here, not in the library: at each byte the longest key of the
model's compiled character map that matches is replaced (a character without a
match stays), white space is treated as the model says, and each normalised byte
records the original byte it came from. The library's segmentation then runs on
the normalised text with its own normalisation turned off, and every piece's
normalised bytes are projected through that record to a span of original bytes.
Where the model's map has no keys, no prefix matches anywhere: every character
stays, and the same record is made without walking the text byte by byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

SPACE = "▁"
MARK = SPACE.encode()
#: Texts are encoded and handed on in groups of at most so many characters (or one text): beside its text, a
#: character costs a worker up to about 60 bytes of offsets, ids and pieces.
CHARS_PER_GROUP = 250_000


class CharacterMap:
    """A model's compiled character map: a double-array trie over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at a position, if any."""
        units, found, node = self.units, None, 0
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= offset(units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            unit = units[node]
            if unit & 0x800000FF != data[n]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Codec:
    """One model's normaliser, encoder and decoder; the decoder is loaded when it is first used."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.path = path
        with open(path, "rb") as f:
            raw = f.read()
        model = pb.ModelProto()
        model.ParseFromString(raw)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.lengths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = self.inner.unk_id()

    @cached_property
    def plain(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes the original byte; one more entry is the end."""
        data = text.encode()
        if not self.map.units and not self.squeeze and self.escape and not self.suffix:
            return self._mapless(text, data)
        parts: list[tuple[int, bytes]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units else None
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, data[at : at + n]
            parts.append((at, hit[1]))
            at += hit[0]
        end = len(data)
        if self.squeeze:
            kept, blank = [], True
            for where, piece in parts:
                while blank and piece.startswith(b" "):
                    piece = piece[1:]
                if piece:
                    kept.append((where, piece))
                    blank = piece.endswith(b" ")
            parts = kept
            while parts and parts[-1][1].endswith(b" "):
                end, piece = parts[-1][0], parts[-1][1].rstrip(b" ")
                parts = [*parts[:-1], (end, piece)] if piece else parts[:-1]
        space = MARK if self.escape else b" "
        out, where = bytearray(), []
        if parts and self.prefix and not self.suffix:
            out += space
            where += [parts[0][0]] * len(space)
        for start, piece in parts:
            piece = piece.replace(b" ", space)
            out += piece
            where += [start] * len(piece)
        if parts and self.prefix and self.suffix:
            out += space
            where += [end] * len(space)
        return out.decode(errors="replace"), np.array([*where, end], np.int64)

    def _mapless(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """The same for a model without a map that only marks spaces, byte by byte in numpy."""
        if not text:
            return "", np.zeros(1, np.int64)
        wide = np.where(np.frombuffer(data, np.uint8) == 0x20, len(MARK), 1)
        where = np.repeat(np.arange(len(data), dtype=np.int64), wide)
        head = np.zeros(len(MARK) if self.prefix else 0, np.int64)
        return SPACE * self.prefix + text.replace(" ", SPACE), np.concatenate([head, where, [len(data)]])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids and each piece's first and last-plus-one original byte."""
        for original in texts:
            text, where = self.normalise(original)
            ids = np.asarray(self.inner.encode(text), np.int32)
            if self.unknown in ids:
                proto = self.inner.encode(text, out_type="immutable_proto")
                ends = np.cumsum([len(p.surface.encode()) for p in proto.pieces], dtype=np.int64)
            else:
                ends = np.cumsum(self.lengths[ids])
            begins = np.concatenate([[0], ends])[:-1].astype(np.int64)
            yield ids, where[begins].astype(np.int32), where[ends].astype(np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.plain.decode(ids) if ids else []


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _field(df: DataFrame, col: str) -> T.StructField:
    return T.StructField(col, df.schema[col].dataType)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Ids and original byte spans of every whole text.

    Returns id_col, the columns in keep, ids, begins and ends (array<int>): piece i
    covers the UTF-8 bytes from begins[i] to ends[i]; a Spark string has less than
    2**31. Pieces of white space that normalisation adds are empty spans. With
    decoded, one more column holds what the model's decoder makes of the ids, by
    the same worker. A null text is an empty one and has no ids. One row per input
    row, in any order. model is a path that every executor can read.
    """
    columns = [id_col, *keep]
    found = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begins", "ends")]
    schema = T.StructType([*(_field(docs, c) for c in columns), *found, *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for part in _groups(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), CHARS_PER_GROUP):
                n = part.stop - part.start
                found = list(tool.encode([x or "" for x in column.slice(part.start, n).to_pylist()]))
                heads = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32))
                out = [pa.ListArray.from_arrays(heads, pa.array(np.concatenate([x[k] for x in found]))) for k in range(3)]
                if decoded:
                    out.append(pa.array(tool.decode([x[0].tolist() for x in found]), pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(part.start, n) for i in range(len(columns))), *out], names=schema.names)

    return small_batches(docs.select(*columns, F.col(text_col).alias("__text"))).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The text that the model's decoder makes of each row's ids.

    Returns the columns in keep and decoded string. Null ids are no ids, whose
    text is empty. One row per input row, in any order.
    """
    schema = T.StructType([*(_field(encoded, c) for c in keep), T.StructField("decoded", T.StringType())])
    columns = [F.col(c) for c in keep] + ([] if ids_col in keep else [F.col(ids_col)])  # once, if it is kept
    at = keep.index(ids_col) if ids_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            column = batch.column(at)
            sizes = [0 if n is None else n for n in column.value_lengths().to_pylist()]
            for part in _groups(sizes, CHARS_PER_GROUP // 4):
                ids = [x or [] for x in column.slice(part.start, part.stop - part.start).to_pylist()]
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(tool.decode(ids), pa.string())], names=schema.names)

    return small_batches(encoded.select(*columns)).mapInArrow(tidy(run), schema)
