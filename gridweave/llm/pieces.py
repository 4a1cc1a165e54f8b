"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols begin as its characters. An agenda holds the adjacent pairs that join to a
piece, best score first and leftmost among equals; joining one makes new pairs with its
neighbours. A pair of characters that stands side by side in no piece can never be joined
over, so the text is cut there, and each distinct stretch of an Arrow batch is worked out once.
The short ones go through their agendas together, a row a stretch; a long one has a heap. The
stretches of each batch are checked against the sentencepiece library.
"""

from __future__ import annotations

import functools
import heapq
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.arrays import as_large, buffer_of, slices
from gridweave.workspace import ship

#: Stretches of up to so many characters are worked out together.
SHORT = 64
#: Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 22
_NEVER = np.int32(2**31 - 1)
#: A word with the marks before it.
_WORD = re.compile("▁*[^▁]+|▁+")


class Pieces:
    """A merge-type vocabulary of a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(m.is_unused(i) for i in range(n)):
            raise ValueError(f"{os.path.basename(path)} has unused pieces, which merges don't know")
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        #: Pairs of characters that stand side by side in some piece.
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # where no piece has a word mark behind another character, words are stretches of their own
        self.words = not any(b[1] == "▁" != b[0] for b in self.beside)
        # a symbol's number is its piece's id, or the vocabulary's size and its code point
        self._of_char = np.arange(0x110000, dtype=np.int32) + n
        for p, i in self.ids.items():
            if len(p) == 1:
                self._of_char[ord(p)] = i
        number = lambda s: self.ids.get(s, n + ord(s) if len(s) == 1 else None)
        order = {s: k for k, s in enumerate(sorted({-s for s in self.score.values()}))}
        joins = {}
        for p, i in self.ids.items():
            for c in range(1, len(p)):
                left, right = number(p[:c]), number(p[c:])
                if left is not None and right is not None:
                    joins[left * (n + 0x110000) + right] = (order[-self.score[p]], i)
        self._keys = np.array(sorted(joins), np.int64)
        self._rank, self._to = (np.array([joins[k][c] for k in self._keys.tolist()] + [0], np.int32) for c in (0, 1))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; the rank of a pair that doesn't join is _NEVER."""
        key = left.astype(np.int64) * (self.size + 0x110000) + right
        at = np.searchsorted(self._keys, key)
        ok = (left >= 0) & (right >= 0) & (self._keys[np.minimum(at, len(self._keys) - 1)] == key) if len(self._keys) else np.zeros(key.shape, bool)
        at = np.where(ok, at, len(self._keys))
        return np.where(ok, self._rank[at], _NEVER), self._to[at]

    def agendas(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of short stretches: in each step each joins its best pair, the leftmost of equals."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        place = np.r_[0, np.cumsum(lengths)]
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ids, counts = np.full(len(chars), -1, np.int64), np.zeros(len(words), np.int64)
        for low, width in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, SHORT)):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            for s in range(0, len(rows), 20_000):
                own = rows[s : s + 20_000]
                col = np.arange(width + 1)[None]
                held = col < lengths[own, None]
                symbol = np.full(held.shape, -1, np.int32)
                at = (place[own, None] + col)[held]
                symbol[held] = self._of_char[chars[at]]
                self._join_all(symbol)
                counts[own] = n = (symbol >= 0).sum(1)
                ids[(place[own, None] + col)[col < n[:, None]]] = symbol[col < n[:, None]]
        owner = np.repeat(np.arange(len(words)), lengths)[ids >= 0]
        ids = ids[ids >= 0]
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):  # characters without a piece are spelt in bytes
            spelt = [self._spelt(x) for x in ids[odd].tolist()]
            more = np.ones(len(ids), np.int64)
            more[odd] = [len(x) for x in spelt]
            ids, owner = np.repeat(ids, more), np.repeat(owner, more)
            ids[ids >= self.size] = [y for x in spelt for y in x]
            counts = np.bincount(owner, minlength=len(words))
        return ids, np.r_[0, np.cumsum(counts)]

    def _join_all(self, symbol: np.ndarray) -> None:
        rank, to = self._look(symbol[:, :-1], symbol[:, 1:])
        col = np.arange(symbol.shape[1])[None]
        rows, now = np.arange(len(symbol)), symbol
        while len(now):
            j = rank.argmin(1)
            each = np.arange(len(now))
            go = rank[each, j] != _NEVER
            symbol[rows[~go]] = now[~go]
            now, rank, to, rows, j = now[go], rank[go], to[go], rows[go], j[go]
            each = np.arange(len(now))
            joined = to[each, j]
            shift = lambda x, end, past: np.where(col[:, : x.shape[1]] > past, np.concatenate([x[:, 1:], np.full((len(x), 1), end, x.dtype)], 1), x)
            now = shift(now, -1, j[:, None])
            now[each, j] = joined
            rank, to = shift(rank, _NEVER, j[:, None]), shift(to, 0, j[:, None])
            rank[each, j], to[each, j] = self._look(now[each, j], now[each, j + 1])
            h = np.maximum(j - 1, 0)
            before = j > 0
            rank[each[before], h[before]], to[each[before], h[before]] = self._look(now[each[before], h[before]], now[each[before], j[before]])

    def _spelt(self, symbol: int) -> list[int]:
        """Ids of a symbol: its own, or its bytes'."""
        if symbol < self.size:
            return [symbol]
        return [self.bytes[b] for b in chr(symbol - self.size).encode()] if self.bytes else [self.unknown]

    def agenda(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of any length, by a heap."""
        n, score = len(text), self.score
        symbol: list[str] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-score[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            # a symbol that has grown or gone since makes the entry stale
            if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != len(piece):
                continue
            symbol[i], symbol[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbol[k]) in score:
                    heapq.heappush(agenda, (-score[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbol[h] + piece) in score:
                heapq.heappush(agenda, (-score[p], h, p))
        return tuple(y for s in symbol if s for y in ([self.ids[s]] if s in self.ids else self._spelt(self.size + ord(s))))

    def stretches(self, text: str) -> list[str]:
        """A normalised text cut into words, and a long word wherever two neighbours stand side by side in no piece."""
        words = _WORD.findall(text) if self.words else [text] if text else []
        if max(map(len, words), default=0) <= SHORT:
            return words
        out = []
        for w in words:
            start = 0
            for i in range(1, len(w) if len(w) > SHORT else 0):
                if w[i - 1 : i + 1] not in self.beside:
                    out.append(w[start:i])
                    start = i
            out.append(w[start:])
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, whether the library agrees) of whole texts."""
        cut = [self.stretches(self.model.normalize(t)) if t else [] for t in texts]
        flat = pa.array([w for own in cut for w in own], pa.string()).dictionary_encode()
        code, words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        short = [w if len(w) <= SHORT else "" for w in words]
        ids, offsets = self.agendas(short)
        # the library puts a mark before what it is given, so short words with a mark can be asked for as they are
        alone = np.array([self.words and w[:1] == "▁" for w in short], bool)
        agrees = np.ones(len(words), bool)
        asked = np.flatnonzero(alone & np.array([w != "▁" for w in short], bool))
        if len(asked):
            right = self.model.encode([words[i][1:].replace("▁", " ") for i in asked.tolist()])
            n = np.fromiter(map(len, right), np.int64, len(right))
            same = n == offsets[asked + 1] - offsets[asked]
            mine = _spans(offsets[asked], np.where(same, n, 0))
            theirs = np.fromiter((y for x, ok in zip(right, same.tolist(), strict=True) if ok for y in x), np.int64, len(mine))
            differ = np.repeat(np.arange(len(asked)), np.where(same, n, 0))[ids[mine] != theirs]
            same[differ] = False
            agrees[asked] = same
        long = [i for i, w in enumerate(words) if len(w) > SHORT]
        if long:
            found = [self.agenda(words[i]) for i in long]
            n = offsets[1:] - offsets[:-1]
            n[long] = [len(x) for x in found]
            ids = np.r_[ids, np.fromiter((y for x in found for y in x), np.int64)]
            starts = offsets[:-1].copy()
            starts[long] = offsets[-1] + np.r_[0, np.cumsum(n[long])][:-1]
        else:
            starts, n = offsets[:-1], offsets[1:] - offsets[:-1]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        out = ids[_spans(starts[code], n[code])]
        ends = np.r_[0, np.cumsum(np.bincount(of, n[code], minlength=len(texts)).astype(np.int64))]
        told = np.bincount(of, ~agrees[code], minlength=len(texts)) == 0
        for i in np.flatnonzero(np.bincount(of, ~alone[code], minlength=len(texts))).tolist():
            told[i] = out[ends[i] : ends[i + 1]].tolist() == self.model.encode(texts[i])
        return out, ends, told


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of spans, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text by the agenda and decode the ids again.

    Returns the id, ``n_tokens``, ``ids`` (decimals joined by commas), ``decoded`` (the library's
    decoding of the ids) and ``agrees``: whether the library gives the same ids for each of the text's
    words, or for the whole text where a stretch isn't a short word that it can be asked for alone.
    Null texts count as empty, which give no ids and an empty text. Each row is by itself: repeated rows
    give repeated results, an empty table an empty one, other columns are not read, and a long text
    without a place to cut is one stretch.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = vocabulary(model_path)
        for batch in batches:
            for i, j in slices(buffer_of(as_large(batch.column(1)))[1], SLICE_BYTES):
                part = batch.slice(i, j - i)
                ids, ends, agrees = own.encode_texts([t or "" for t in part.column(1).to_pylist()])
                decoded = [own.model.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                decimals = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()).cast(pa.string())), ",")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), decimals, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded", "agrees"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids string, decoded string, agrees boolean")


def digests(docs: DataFrame, model_path: str, **columns) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of ids and decoded text as lower-case hex, and ``agrees``."""
    out = encode(docs, model_path, **columns)
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
