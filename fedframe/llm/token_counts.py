"""Token counts that follow edits.

A document's text is cut into pre-tokens, the units that the tokenizer never
merges across. Each is a leaf with its characters and tokens; leaves are kept in
chunks, and a binary tree over the chunks holds the sums. An edit walks down the
tree to the leaves it touches, takes in the boundary context before them, cuts
and encodes the new text from there until a cut falls on an old one, and then
updates the sums on the way back up. Everything else keeps its counts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

#: Leaves in a chunk; a chunk that grows to four times this is cut again.
CHUNK = 64
#: Token counts of pre-tokens that a worker remembers, of at most so many characters.
REMEMBERED, SHORT = 300_000, 40
CHARS_PER_GROUP = 2_000_000


class Tokenizer:
    """Ranks and pattern of a byte-level tokenizer, with remembered pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


class TokenTree:
    """Characters and tokens of a text's pre-tokens, with sums over chunks of them."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]):
        self.chars = [list(chars[i : i + CHUNK]) for i in range(0, len(chars), CHUNK)] or [[]]
        self.tokens = [list(tokens[i : i + CHUNK]) for i in range(0, len(tokens), CHUNK)] or [[]]
        self._sum()

    def _sum(self) -> None:
        level = [(sum(c), sum(t)) for c, t in zip(self.chars, self.tokens, strict=True)]
        self.levels = [level]
        while len(level) > 1:
            level = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            self.levels.append(level)

    @classmethod
    def of(cls, text: str, tool: Tokenizer) -> TokenTree:
        pieces = tool.cut.findall(text)
        return cls(list(map(len, pieces)), list(map(tool.count, pieces)))

    @property
    def n_chars(self) -> int:
        return self.levels[-1][0][0]

    @property
    def n_tokens(self) -> int:
        return self.levels[-1][0][1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for c in self.chars for x in c], [x for t in self.tokens for x in t]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Chunk, leaf in it and first character of the leaf that holds character `at`."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(level) and start + level[node][0] <= at:
                start += level[node][0]
                node += 1
        for leaf, n in enumerate(self.chars[node]):
            if start + n > at:
                return node, leaf, start
            start += n
        return node, len(self.chars[node]), start

    def _before(self, chunk: int, leaf: int, start: int) -> tuple[int, int, int] | None:
        while leaf == 0:
            if chunk == 0:
                return None
            chunk -= 1
            leaf = len(self.chars[chunk])
        return chunk, leaf - 1, start - self.chars[chunk][leaf - 1]

    def edit(self, text: str, start: int, stop: int, put: str, tool: Tokenizer) -> tuple[str, int]:
        """Replace text[start:stop] by put: the new text, and how many characters were encoded again."""
        new = text[:start] + put + text[stop:]
        chunk, leaf, first = self._find(max(0, start - 1))
        # A cut depends on what follows it: on one character, or on a run of white space and one more.
        while back := self._before(chunk, leaf, first):
            chunk, leaf, first = back
            if not text[first : first + self.chars[chunk][leaf]].isspace():
                break
        shift, at = len(put) - (stop - start), first
        end_chunk, end_leaf, end = chunk, leaf, first  # the old leaf that begins at character `end`
        chars, tokens = [], []
        for found in tool.cut.finditer(new, first):
            piece = found.group()
            chars.append(len(piece))
            tokens.append(tool.count(piece))
            at = found.end()
            while end < at - shift or end < stop:
                if end_leaf < len(self.chars[end_chunk]):
                    end += self.chars[end_chunk][end_leaf]
                    end_leaf += 1
                elif end_chunk + 1 < len(self.chars):
                    end_chunk, end_leaf = end_chunk + 1, 0
                else:
                    break
            if end == at - shift and end >= stop:
                break
        else:
            end_chunk, end_leaf = len(self.chars) - 1, len(self.chars[-1])
        self._replace(chunk, leaf, end_chunk, end_leaf, chars, tokens)
        return new, at - first

    def _replace(self, chunk: int, leaf: int, end_chunk: int, end_leaf: int, chars: list[int], tokens: list[int]) -> None:
        rest = self.chars[end_chunk][end_leaf:], self.tokens[end_chunk][end_leaf:]
        touched = range(chunk, end_chunk + 1)
        self.chars[chunk] = self.chars[chunk][:leaf] + chars + (rest[0] if chunk == end_chunk else [])
        self.tokens[chunk] = self.tokens[chunk][:leaf] + tokens + (rest[1] if chunk == end_chunk else [])
        for i in touched[1:]:
            self.chars[i], self.tokens[i] = (rest[0], rest[1]) if i == end_chunk else ([], [])
        if len(self.chars[chunk]) > 4 * CHUNK:
            self.__init__(*self.leaves())
            return
        for i in touched:
            self.levels[0][i] = sum(self.chars[i]), sum(self.tokens[i])
        low, high = touched[0], touched[-1]
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                pair = below[2 * i : 2 * i + 2]
                level[i] = sum(x[0] for x in pair), sum(x[1] for x in pair)


def _groups(texts: list[str]) -> Iterator[slice]:
    start, total = 0, 0
    for i, x in enumerate(texts):
        if i > start and total + len(x) > CHARS_PER_GROUP:
            yield slice(start, i)
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield slice(start, len(texts))


def _lists(values: list[list[int]]) -> pa.Array:
    heads = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(heads), pa.array([x for v in values for x in v], pa.int32()))


LEAVES = [T.StructField("n_tokens", T.LongType()), T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType()))]


def count(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Count every whole text and keep its tree's leaves.

    Returns the columns in keep, n_tokens, leaf_chars and leaf_tokens. A null text
    is an empty one: no leaves, no tokens. One row per input row.
    """
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *LEAVES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for part in _groups(texts):
                cut = [tool.cut.findall(x) for x in texts[part]]
                chars, tokens = [list(map(len, x)) for x in cut], [list(map(tool.count, x)) for x in cut]
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(list(map(sum, tokens)), pa.int64()), _lists(chars), _lists(tokens)], names=schema.names)

    return small_batches(docs.select(*keep, F.col(text_col).alias("__text"))).mapInArrow(tidy(run), schema)


def recount(counted: DataFrame, path: str, pattern: str, text_col: str = "text", edits_col: str = "edits", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Apply edits and bring the counts up to date, encoding only what they touch.

    counted has the text before the edits, leaf_chars, leaf_tokens and edits_col,
    array<struct<start, stop, put>> in characters, each applied to what the one
    before left; bounds outside the text are moved to its ends, null edits change
    nothing. Returns the columns in keep, text (edited), n_tokens, leaf_chars,
    leaf_tokens and n_encoded, the characters that were encoded again.
    """
    schema = T.StructType([*(T.StructField(c, counted.schema[c].dataType) for c in keep), T.StructField("text", T.StringType()), *LEAVES, T.StructField("n_encoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(path, pattern)
        for batch in batches:
            whole = [x or "" for x in batch.column(len(keep)).to_pylist()]
            for part in _groups(whole):
                n = part.stop - part.start
                chars, tokens, edits = (batch.column(len(keep) + k).slice(part.start, n).to_pylist() for k in (1, 2, 3))
                texts, trees, encoded = [], [], []
                for text, c, t, changes in zip(whole[part], chars, tokens, edits, strict=True):
                    tree, again = TokenTree(c or [], t or []), 0
                    for change in changes or []:
                        if change is None or change["start"] is None or change["stop"] is None:
                            continue
                        start = min(max(0, change["start"]), len(text))
                        text, m = tree.edit(text, start, min(max(start, change["stop"]), len(text)), change["put"] or "", tool)
                        again += m
                    texts.append(text)
                    trees.append(tree)
                    encoded.append(again)
                leaves = [x.leaves() for x in trees]
                kept = [batch.column(i).slice(part.start, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([x.n_tokens for x in trees], pa.int64()), _lists([x[0] for x in leaves]), _lists([x[1] for x in leaves]), pa.array(encoded, pa.int64())], names=schema.names)

    ready = counted.select(*keep, F.col(text_col).alias("__text"), "leaf_chars", "leaf_tokens", F.col(edits_col).alias("__edits"))
    return small_batches(ready).mapInArrow(tidy(run), schema)
