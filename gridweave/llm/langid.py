"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; a text's
probability in a language is the sum over all ways to cut its words into pieces, by the
forward algorithm. Words are letters only, lower-cased, after a mark for their start.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridweave.llm.arrays import SLICE_BYTES, BatchWords, Hasher, U, give_back, row_slices
from gridweave.workspace import ship


#: Words of up to so many bytes go by length; longer ones in steps of so many, rescaled after each.
STEP_BYTES = 32
#: Numbers that an array of the forward algorithm holds: languages, words and bytes share them.
NUMBERS = 2_000_000
#: Probabilities are scaled up by this for every byte of a piece, so that no product of a step runs out of
#: a double's range; it is taken off again in the logarithm.
BYTE_SCALE = 4096.0
#: Pseudo-count of each piece in each language, and the most languages a model may hold.
SMOOTHING, MAX_LANGUAGES = 0.5, 1000
UNKNOWN = "und"


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentencepiece model as bytes, word starts as a space; then the 256 single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    pieces = {p.replace("▁", " ").lower().encode() for p in plain}
    pieces = sorted(p for p in pieces if len(p) > 1)
    return pieces + [bytes([i]) for i in range(256)]


class Lookup:
    """Piece numbers of spans of a buffer, by an open table of their hashes."""

    def __init__(self, pieces: list[bytes]):
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        keys = Hasher(buf).spans(np.r_[0, ends[:-1]], ends)
        self.size = np.array([len(p) for p in pieces])
        self.sizes = np.unique(self.size)  # ascending
        self.longest = int(self.sizes[-1])
        self.mask = U((1 << 18) - 1)
        self.keys, self.ids = np.zeros(1 << 18, U), np.full(1 << 18, -1, np.int32)
        self.more: dict[int, int] = {}
        for k, h in enumerate(keys.tolist()):
            at = h & int(self.mask)
            while self.ids[at] >= 0:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.ids[at] = h, k
        taken = self.ids >= 0
        self.reach = int(max(np.diff(np.flatnonzero(np.r_[True, ~taken, True])).max(), 1))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        out = np.where(self.keys[at] == keys, self.ids[at], -1)
        left = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        for step in range(1, self.reach):
            if not len(left):
                break
            to = (at[left] + U(step)) & self.mask
            hit = self.keys[to] == keys[left]
            out[left[hit]] = self.ids[to[hit]]
            left = left[~hit & (self.ids[to] >= 0)]
        return out


@functools.lru_cache(maxsize=2)
def lookup(path: str) -> Lookup:
    return Lookup(vocabulary(path))


class Spelt:
    """Words as bytes, each after a mark for its start; one without letters has none."""

    def __init__(self, words: list[str]):
        raw = [(" " + w).encode() if w else b"" for w in words]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.hasher = Hasher(np.frombuffer(b"".join(raw), np.uint8))
        self.end = int(self.size.sum())

    def short(self, each: int):
        """(length, words, starts) of words of equal length, so many numbers each at most."""
        for n in np.unique(self.size[(self.size > 0) & (self.size <= STEP_BYTES)]):
            own = np.flatnonzero(self.size == n)
            most = max(1, NUMBERS // (each * (int(n) + 1)))
            for k in range(0, len(own), most):
                part = own[k : k + most]
                yield int(n), part, self.start[part]

    def long(self, each: int):
        """Longer words, the longest first, few enough for so many numbers a byte of a step."""
        own = np.flatnonzero(self.size > STEP_BYTES)
        own = own[np.argsort(-self.size[own], kind="stable")]
        most = max(1, NUMBERS // (each * 8 * STEP_BYTES))
        for k in range(0, len(own), most):
            yield own[k : k + most]

    def ending(self, find: Lookup, words: np.ndarray, at: int) -> np.ndarray:
        """Piece by (place, size, word) of those that end 1 to ``STEP_BYTES`` bytes after ``at``; -1 for none."""
        to = self.start[words] + at + np.arange(1, STEP_BYTES + 1)[:, None]
        return self._between(find, words, to[:, None] - find.sizes[None, :, None], np.repeat(to[:, None], len(find.sizes), 1))

    def starting(self, find: Lookup, words: np.ndarray, at: int) -> np.ndarray:
        """The same of those that start 0 to ``STEP_BYTES`` - 1 bytes after ``at``."""
        a = self.start[words] + at + np.arange(STEP_BYTES)[:, None]
        return self._between(find, words, np.repeat(a[:, None], len(find.sizes), 1), a[:, None] + find.sizes[None, :, None])

    def _between(self, find, words, a, b):
        inside = (a >= self.start[words]) & (b <= self.start[words] + self.size[words])
        out = np.full(a.shape, -1, np.int64)
        out[inside] = find(self.hasher.spans(a[inside], b[inside]))
        return out


def scaled(p: np.ndarray, find: Lookup) -> np.ndarray:
    """Probabilities with their bytes' scale, and a last row of zeros for no piece."""
    return np.concatenate([p * BYTE_SCALE ** find.size[:, None], np.zeros((1, p.shape[1]))])


def _forward(spelt: Spelt, words: np.ndarray, find: Lookup, p: np.ndarray):
    """Steps of the forward algorithm over long words, longest first.

    Gives (first byte, words that reach it, pieces, alpha, log of alpha's scale) by step; alpha[t] is
    that of byte ``first + t - longest + 1``, scaled alike within a step.
    """
    reach = find.longest
    alpha = np.zeros((reach, len(words), p.shape[1]))
    alpha[-1] = 1
    log = np.zeros((len(words), p.shape[1]))
    for at in range(0, int(spelt.size[words[0]]), STEP_BYTES):
        n = int(np.searchsorted(-spelt.size[words], -at))  # those longer than ``at``
        piece = spelt.ending(find, words[:n], at)
        a = np.concatenate([alpha[:, :n], np.zeros((STEP_BYTES, n, p.shape[1]))])
        for i in range(STEP_BYTES):
            a[reach + i] = (a[reach + i - find.sizes] * p[piece[i]]).sum(0)
        yield at, n, piece, a, log[:n]
        alpha = a[STEP_BYTES:]
        top = alpha.max(0)
        top[top == 0] = 1  # beyond a word's end
        alpha = alpha / top
        log = log[:n] + np.log(top)


def log_likelihood(words: list[str], find: Lookup, p: np.ndarray) -> np.ndarray:
    """log of the sum over segmentations of each word, by language; words without letters give 0.

    ``p`` is as ``scaled`` gives it.
    """
    k = p.shape[1]
    out = np.zeros((len(words), k))
    spelt = Spelt(words)
    for n, word, at in spelt.short(k):
        alpha = np.zeros((n + 1, len(word), k))
        alpha[0] = 1
        for i in range(1, n + 1):
            for size in find.sizes[find.sizes <= i]:
                piece = find(spelt.hasher.spans(at + i - size, at + i))
                ok = np.flatnonzero(piece >= 0)
                alpha[i, ok] += alpha[i - size, ok] * p[piece[ok]]
        out[word] = np.log(alpha[n])
    for word in spelt.long(k * len(find.sizes)):
        for at, n, _, alpha, log in _forward(spelt, word, find, p):
            done = np.flatnonzero(spelt.size[word[:n]] <= at + STEP_BYTES)
            out[word[done]] = log[done] + np.log(alpha[spelt.size[word[done]] - at + find.longest - 1, done])
    return out - spelt.size[:, None] * np.log(BYTE_SCALE)


def expected_counts(words: list[str], weights: np.ndarray, find: Lookup, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows) by language, over all segmentations under one probability a piece.

    ``p`` is a column as ``scaled`` gives it.
    """
    out = np.zeros((len(p) - 1, weights.shape[1]))
    spelt = Spelt(words)
    row, lang = np.nonzero(weights)
    many = np.bincount(row, minlength=len(words))
    first = np.cumsum(many) - many

    def add(word, piece, post):
        rep = np.repeat(np.arange(len(word)), many[word])
        at = first[word][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many[word]) - many[word], many[word])
        np.add.at(out, (piece[rep], lang[at]), post[rep] * weights[row[at], lang[at]])

    one = p[:, 0]
    for n, word, at in spelt.short(2 + len(find.sizes)):
        alpha, beta, uses = np.zeros((n + 1, len(word))), np.zeros((n + 1, len(word))), {}
        alpha[0] = beta[n] = 1
        for i in range(1, n + 1):
            for size in find.sizes[find.sizes <= i]:
                piece = find(spelt.hasher.spans(at + i - size, at + i))
                ok = np.flatnonzero(piece >= 0)
                if len(ok):
                    uses[i - size, i] = ok, piece[ok]
                    alpha[i, ok] += alpha[i - size, ok] * one[piece[ok]]
        for j in range(n - 1, -1, -1):
            for size in find.sizes[find.sizes <= n - j]:
                if (j, j + size) in uses:
                    ok, piece = uses[j, j + size]
                    beta[j, ok] += one[piece] * beta[j + size, ok]
        ok = np.concatenate([x[0] for x in uses.values()])
        piece = np.concatenate([x[1] for x in uses.values()])
        post = np.concatenate([alpha[j, o] * one[q] * beta[i, o] for (j, i), (o, q) in uses.items()]) / alpha[n][ok]
        add(word[ok], piece, post)
    reach = find.longest
    for word in spelt.long(2 + len(find.sizes)):
        steps = list(_forward(spelt, word, find, p))
        size = spelt.size[word]
        whole = np.zeros(len(word))
        for at, n, _, alpha, log in steps:
            done = np.flatnonzero(size[:n] <= at + STEP_BYTES)
            whole[done] = log[done, 0] + np.log(alpha[size[done] - at + reach - 1, done, 0])
        state, back = np.zeros((reach, 0)), np.zeros(0)  # of the bytes after a step, and the log of their scale
        for at, n, piece, alpha, log in reversed(steps):
            beta = np.zeros((STEP_BYTES + reach, n))
            beta[STEP_BYTES:, : state.shape[1]] = state
            back = np.r_[back, np.zeros(n - len(back))]
            ends = np.flatnonzero(size[:n] <= at + STEP_BYTES)
            beta[size[ends] - at, ends] = 1
            from_here = spelt.starting(find, word[:n], at)
            for j in range(STEP_BYTES - 1, -1, -1):
                beta[j] += (beta[j + find.sizes] * one[from_here[j]]).sum(0)
            scale = np.exp(log[:, 0] + back - whole[:n])
            for i in range(STEP_BYTES):
                post = alpha[reach + i - find.sizes, :, 0] * one[piece[i]] * beta[i + 1] * scale
                k, w = np.nonzero(piece[i] >= 0)
                add(word[w], piece[i][k, w], post[k, w])
            top = beta[:reach].max(0)
            top[top == 0] = 1
            state, back = beta[:reach] / top, back + np.log(top)
    return out


def train(docs: DataFrame, vocabulary_path: str) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each piece by language) from (text, lang) of all rows of ``docs``.

    One step of expectation maximisation from uniform pieces. The model is bounded by the
    vocabulary and ``MAX_LANGUAGES``; rows whose lang is null don't count.
    """
    ship(docs.sparkSession)
    docs = docs.where("lang is not null").select("text", "lang")
    langs = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs.sort()
    number = {x: i for i, x in enumerate(langs)}
    n_pieces = len(vocabulary(vocabulary_path))

    def run(batches):
        total = np.zeros((n_pieces, len(langs)))
        find = lookup(vocabulary_path)
        uniform = scaled(np.full((n_pieces, 1), 1 / n_pieces), find)
        for b in row_slices(batches, 0, 2 * SLICE_BYTES):
            w = BatchWords(b.column(0))
            lang = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            weights = np.zeros((len(w.letters), len(langs)))
            np.add.at(weights, (w.of, lang[w.doc]), 1)
            total += expected_counts(w.letters, weights, find, uniform)
            del w, weights, lang
        give_back()
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(total[piece, k])], ["piece", "lang", "n"])

    got = docs.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((n_pieces, len(langs)), SMOOTHING)
    counts[got["piece"], got["lang"]] += np.round(got["n"].to_numpy(), 6)
    return langs, counts / counts.sum(0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs``.

    The score is the language's probability among all, each equally likely before. A null
    text, or one without a letter, is ``und`` with score 0, as is every text if the model has no
    language. Ties go to the first language in code-point order. Each row is by itself;
    an empty table gives an empty result; other columns are not read.
    """
    return _told(docs, model, vocabulary_path, id_col, text_col).select("doc_id", "lang_pred", "score")


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary_path: str) -> DataFrame:
    """``docs`` as a struct ``row``, with what ``identify`` says of each; rows stay where they are."""
    rest = [c for c in docs.columns if c != "text"]
    out = _told(docs, model, vocabulary_path, "doc_id", "text", F.struct(*rest))
    return out.select(F.struct(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]).alias("row"), "lang_pred", "score")


def _told(docs: DataFrame, model, vocabulary_path: str, id_col: str, text_col: str, rest=None) -> DataFrame:
    langs, p = model
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([rest.alias("rest")] if rest is not None else []))
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        find = lookup(vocabulary_path)
        probability = scaled(shared.value, find)
        for b in row_slices(batches, 1, 2 * SLICE_BYTES):
            w = BatchWords(b.column(1))
            n = len(b)
            each = log_likelihood(w.letters, find, probability) if langs else np.zeros((len(w.letters), 0))
            total = np.stack([np.bincount(w.doc, each[w.of, k], minlength=n) for k in range(len(langs))], 1) if langs else np.zeros((n, 1))
            has = np.bincount(w.doc, np.array([bool(x) for x in w.letters], bool)[w.of] if len(w.of) else None, minlength=n) > 0
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            known = has & bool(langs)
            pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[carry], pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], names)
            del w, each, total
        give_back()

    carry = slice(1, 3) if rest is not None else slice(0, 0)
    fields = [narrow.schema["doc_id"], *narrow.schema.fields[1:3][: 2 if rest is not None else 0], StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    names = [f.name for f in fields]
    return narrow.mapInArrow(run, StructType(fields))
