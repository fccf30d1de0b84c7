"""Language identification by unigrams over pieces, summed over all segmentations.

The vocabulary is a public tokenizer's. Each language has a probability for every
piece, fitted by expectation-maximisation on labelled texts: the expected count of
a piece over all segmentations of the words, by a forward and a backward pass. A
text's score is the sum over its words of the logarithm of the forward pass's
total, the probability of the word however it is cut. Pieces never cross words,
so this is the whole text's sum over segmentations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from .common import short_reads, small_batches, split_words, tidy

MARK = "▁"
#: Labelled documents a language that are fitted on.
MAX_DOCS_PER_LANGUAGE = 400
ROUNDS = 2
#: Longer words are fitted as several, so that a probability doesn't vanish.
FIT_LENGTH = 100
#: Of a language's probability, the share spread evenly over all pieces.
EVEN_SHARE = 1e-4
#: A character that is no piece has this probability in every language.
UNKNOWN = 1e-7
#: Parts of one length are scored together, at most so many at once; the fewer, the longer above LONG.
TOGETHER, LONG = 4_000, 24
#: Scores of words that a worker remembers, and the characters of the texts it looks at together.
REMEMBERED = 100_000
CHARS_PER_GROUP = 500_000
UNDECIDED = "und"


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """The vocabulary's plain pieces with their numbers, and the longest one's length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: i for i, p in enumerate(plain)}, max(map(len, plain))


def fit(counts: dict[str, float], vocabulary: dict[str, int], longest: int, rounds: int = ROUNDS) -> dict[int, float]:
    """Probabilities of the pieces that make up words with these counts."""
    cuts = []
    for word, n in counts.items():
        text = MARK + word
        cuts.append((n, len(text), [(i, j, vocabulary.get(text[i:j], -1)) for j in range(1, len(text) + 1) for i in range(max(0, j - longest), j) if text[i:j] in vocabulary or j == i + 1]))
    used = {p for _, _, arcs in cuts for _, _, p in arcs if p >= 0}
    chance = dict.fromkeys(used, 1 / max(1, len(used)))
    for _ in range(rounds):
        expected = dict.fromkeys(used, 0.0)
        for n, length, arcs in cuts:
            forward, backward = [1.0] + [0.0] * length, [0.0] * length + [1.0]
            for i, j, p in arcs:
                forward[j] += forward[i] * (chance[p] if p >= 0 else UNKNOWN)
            for i, j, p in reversed(arcs):
                backward[i] += backward[j] * (chance[p] if p >= 0 else UNKNOWN)
            if not forward[length]:
                continue
            share = n / forward[length]
            for i, j, p in arcs:
                if p >= 0:
                    expected[p] += forward[i] * chance[p] * backward[j] * share
        total = sum(expected.values()) or 1.0
        chance = {p: x / total for p, x in expected.items()}
    return {p: x for p, x in chance.items() if x > 1e-12}


class Vocabulary:
    """Pieces found by 64-bit hashes of their characters, many at once.

    A hash is a polynomial over mixed code points, so that it grows by a character
    in one step. Two tables of slots, by different bits, hold the pieces; the few
    that find their slot in both taken are looked up by search.
    """

    SLOTS = 20

    def __init__(self, numbers: dict[str, int], longest: int):
        self.numbers, self.longest, self.size = numbers, longest, len(numbers)
        #: No piece mixes letters with others, so that words fall apart there.
        self.apart = not any(len(runs(p.lstrip(MARK))) > 1 for p in numbers)
        hashes = np.array([self._hash_one(p) for p in numbers], np.uint64)
        self.hashes = np.concatenate([hashes, [np.uint64(0)]])  # the last stands for none
        self.first = np.full(1 << self.SLOTS, self.size, np.int32)
        self.second = np.full(1 << self.SLOTS, self.size, np.int32)
        where = self._slots(hashes)
        self.first[where[0]] = np.arange(self.size)
        lost = np.nonzero(self.first[where[0]] != np.arange(self.size))[0]
        self.second[where[1][lost]] = lost
        left = lost[self.second[where[1][lost]] != lost]
        self.rest = {int(hashes[i]): int(i) for i in left}

    @staticmethod
    def mixed(codes: np.ndarray) -> np.ndarray:
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    @staticmethod
    def grown(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c) * np.uint64(0xD6E8FEB86659FD93)

    def _hash_one(self, text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in self.mixed(np.array([ord(x) for x in text])):
            h = self.grown(h, c)
        return h[0]

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << self.SLOTS) - 1)
        return (h >> np.uint64(64 - self.SLOTS)).astype(np.int64), ((h >> np.uint64(20)) & low).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or size where there is none."""
        a, b = self._slots(h)
        found = self.first[a]
        found = np.where(self.hashes[found] == h, found, self.second[b])
        found[self.hashes[found] != h] = self.size
        if self.rest:
            for value, number in self.rest.items():
                found[h == np.uint64(value)] = number
        return found


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(*pieces(path))


_RUNS = regex.compile(r"\p{L}+|\P{L}+")


def runs(word: str) -> list[str]:
    """A word's runs of letters and of other characters."""
    if word.isalpha():
        return [word]
    return [word[:-1], word[-1]] if word[:-1].isalpha() else _RUNS.findall(word)


class Model:
    """Languages and the probability of each piece in each of them."""

    def __init__(self, languages: list[str], chances: np.ndarray):
        self.languages, self.chances = languages, chances

    def score_parts(self, parts: list[str], vocabulary: Vocabulary) -> np.ndarray:
        """Parts (words after MARK, or runs of them) by languages: the logarithm of each
        one's probability over all segmentations, by the forward pass over many at once."""
        out = np.zeros((len(parts), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            by_length.setdefault(len(part), []).append(i)
        for length, members in by_length.items():
            step = max(1, TOGETHER // max(1, length // LONG))
            for k in range(0, len(members), step):
                rows = members[k : k + step]
                codes = np.frombuffer("".join([parts[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), length)
                letters = vocabulary.mixed(codes.T)
                # sums[j]: probability of the first j characters; only those in reach of a piece are kept.
                sums = {0: np.ones((len(rows), len(self.languages)))}
                scale = np.zeros((len(rows), 1))
                for i in range(length):
                    start = sums.pop(i)
                    if i and i % 16 == 0:
                        peak = np.maximum(start.max(axis=1, keepdims=True), 1e-300)
                        scale += np.log(peak)
                        start = start / peak
                        sums = {j: x / peak for j, x in sums.items()}
                    h = np.zeros(len(rows), np.uint64)
                    for j in range(i + 1, min(length, i + vocabulary.longest) + 1):
                        h = vocabulary.grown(h, letters[j - 1])
                        found = vocabulary.find(h)
                        if j not in sums:
                            sums[j] = np.zeros_like(start)
                        if j == i + 1:  # a character that is no piece has a probability too
                            sums[j] += start * self.chances[found]
                            continue
                        hit = np.nonzero(found < vocabulary.size)[0]
                        if len(hit):
                            sums[j][hit] += start[hit] * self.chances[found[hit]]
                out[rows] = np.log(np.maximum(sums[length], 1e-300)) + scale
        return out

    def judge(self, scores: np.ndarray) -> tuple[str, float]:
        """The likeliest language and its share of the probability, all equally likely before."""
        best = int(scores.argmax())
        return self.languages[best], float(1 / np.exp(scores - scores[best]).sum())


def choose(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int) -> DataFrame:
    """lang and text of the first max_docs rows a language by a hash of the id, and of all that have the last one's hash.

    A task keeps max_docs hashes a language at most. What is joined is one row a
    language, the last one's hash, so that nothing is sorted, no text is shuffled
    and no table is written.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    last = rows.groupBy(F.col("lang").alias("of")).agg(F.array_max(InternalFunction.collect_top_k(F.col("h"), max_docs, True)).alias("last"))
    return rows.join(F.broadcast(last), (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("last"))).select("lang", "text")


def train(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Fit on at most max_docs documents a language, chosen by a hash of their id and taken whole.

    Rows without text or language are left out. Words are counted by Spark, and
    each language is fitted in a task of its own; the driver gets at most the
    vocabulary for each language. Without any row the model has no language.
    """
    texts = choose(short_reads(docs), id_col, text_col, lang_col, max_docs)
    counts = texts.select("lang", F.explode(split_words(F.col("text"))).alias("word")).where("word <> ''").groupBy("lang", "word").count()

    def one(key: tuple, table: pa.Table) -> pa.Table:
        vocabulary, longest = pieces(vocabulary_path)
        merged: dict[str, float] = {}
        for word, n in sorted(zip(table.column("word").to_pylist(), table.column("count").to_pylist(), strict=True)):
            for i in range(0, len(word), FIT_LENGTH):
                merged[word[i : i + FIT_LENGTH]] = merged.get(word[i : i + FIT_LENGTH], 0.0) + n
        found = fit(merged, vocabulary, longest, rounds)
        return pa.table({"lang": [key[0].as_py()] * len(found), "piece": pa.array(list(found), pa.int32()), "chance": pa.array(list(found.values()), pa.float64())})

    fitted = counts.groupBy("lang").applyInArrow(one, "lang string, piece int, chance double").toArrow()
    vocabulary, _ = pieces(vocabulary_path)
    languages = sorted(set(fitted.column("lang").to_pylist()))
    chances = np.full((len(vocabulary) + 1, len(languages)), EVEN_SHARE / max(1, len(vocabulary)))
    where = {x: i for i, x in enumerate(languages)}
    column = np.array([where[x] for x in fitted.column("lang").to_pylist()], int)
    chances[fitted.column("piece").to_numpy(), column] += (1 - EVEN_SHARE) * fitted.column("chance").to_numpy()
    chances[len(vocabulary)] = UNKNOWN
    return Model(languages, chances)


class _Known(dict):
    """Numbers of the words (or parts) met so far, and a table of their scores."""

    def __init__(self, model: Model, vocabulary: Vocabulary):
        super().__init__()
        self.model, self.vocabulary = model, vocabulary
        self.new: list[str] = []
        self.table = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def forget(self) -> None:
        self.clear()
        self.table = np.zeros((1024, len(self.model.languages)))

    def put(self, scores: np.ndarray) -> None:
        """The scores of the new ones, in their order."""
        n = len(self)
        if n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((2 * n - len(self.table), self.table.shape[1]))])
        self.table[n - len(self.new) : n] = scores
        self.new = []

    def learn(self, parts: _Known) -> None:
        """Score the new words: of each one its parts, scored once for all words that share them."""
        if not self.new:
            return
        if self.vocabulary.apart:
            cut = [runs(w) for w in self.new]
            cut = [[MARK + c[0], *c[1:]] for c in cut]
        else:
            cut = [[MARK + w] for w in self.new]
        numbers = np.fromiter(map(parts.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if parts.new:
            parts.put(self.model.score_parts(parts.new, self.vocabulary))
        self.put(np.add.reduceat(parts.table[numbers], np.cumsum([0, *map(len, cut)])[:-1], axis=0))


def _groups(members: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Members in groups of at most CHARS_PER_GROUP characters, or of one text."""
    group, total = [], 0
    for i in members:
        if group and total + len(texts[i]) > CHARS_PER_GROUP:
            yield group
            group, total = [], 0
        group.append(i)
        total += len(texts[i])
    if group:
        yield group


def identify(docs: DataFrame, model: Model, vocabulary_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The language of every whole text.

    Returns the columns in keep, lang_pred string and score double (the share of
    the probability that the language has, 0 to 1). A text that is null or has no
    letter, or any text if the model has no language, is `und` with score 0. One
    row per input row; nothing but the text is looked at.
    """
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.chances))  # vocabulary by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocabulary = Model(*shared.value), vocabulary_of(vocabulary_path)
        words, parts = _Known(own, vocabulary), _Known(own, vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
            judged = [i for i, x in enumerate(texts) if x is not None and own.languages and any(map(str.isalpha, x))]
            for group in _groups(judged, texts):
                cut = [texts[i].split() for i in group]
                numbers = np.fromiter(map(words.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
                words.learn(parts)
                heads = np.cumsum([0, *map(len, cut)])[:-1]
                for i, total in zip(group, np.add.reduceat(words.table[numbers], heads, axis=0), strict=True):
                    lang, score = own.judge(total)
                    langs[i], scores[i] = lang, score if math.isfinite(score) else 0.0
                for held in (words, parts):
                    if len(held) > REMEMBERED:
                        held.forget()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return small_batches(short_reads(docs).select(*keep, F.col(text_col).alias("__text"))).mapInArrow(tidy(run), schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document is held out of training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False)) if isinstance(id_col, str) else id_col
