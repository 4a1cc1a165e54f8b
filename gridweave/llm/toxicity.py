"""Toxicity: a learnt lexicon, misspellings by automaton, and scores by context.

Terms and stems are words and word beginnings that toxic training documents have and
others don't. They form a trie; the automaton that accepts what lies within a term's number of
edits walks it, so each distinct word of a batch is read once. A hit counts by the term's
purity, less if misspelt, more with another hit near, and less where it is quoted or reported.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.arrays import BatchWords, row_slices
from gridweave.workspace import Workspace, ship

#: Labelled rows that the lexicon is learnt from at most, by a seeded order.
LABELLED_ROWS = 200_000
#: A term follows at least so many different words in toxic documents (copies of one text show it
#: after one), and a stem begins so many different words.
MIN_CONTEXTS, STEM_WORDS = 5, 4
STEM_LENGTHS = (4, 5, 6)
#: Least share of toxic documents, all else equal, among the documents with a term.
PURITY = 0.8
#: Words on either side that make a hit's context, and how much of a hit remains.
WINDOW = 8
MISSPELT, CLUSTERED, QUOTED = 0.5, 0.65, 0.25
#: Weight of terms that few contexts show, and the least weight of the others.
WEAK, SURE = 0.5, 0.8
BASE = 0.02
#: Words that report what somebody said, in four languages.
REPORTING = set(
    "said says wrote writes called calls quote quoted quotes word term slur insult "
    "sagte schrieb nannte zitat wort begriff dit disait mot terme citation dijo llamó palabra cita".split()
)


def edits_of(term: str) -> int:
    """Edits within which a word is a misspelling of a term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms over their trie, made state by state as words need them."""

    MEMO = 400_000

    def __init__(self, terms: dict[str, float], stems: dict[str, float], rigid: frozenset[str] = frozenset()):
        self.edits = {t: 0 if t in rigid or p < SURE else edits_of(t) for t, p in terms.items()}
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for t in sorted(terms):
            node, limit = 0, self.edits[t]
            self.most[0] = max(self.most[0], limit)
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], limit)
            self.term[node] = t
        self.alphabet = {c for x in self.children for c in x}
        self.terms, self.stems = terms, stems
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The number of a set of nodes with their least edits, with what may be left out of a term."""
        todo = sorted(at.items(), key=lambda x: x[1])
        while todo:
            node, e = todo.pop()
            if at[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < at.get(child, 99):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(at.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        to: dict[int, int] = {}

        def put(node, e):
            if e <= self.most[node] and e < to.get(node, 99):
                to[node] = e

        for node, e in self.states[state]:
            if ch in self.children[node]:
                put(self.children[node][ch], e)
            put(node, e + 1)
            for child in self.children[node].values():
                put(child, e + 1)
        return self._state(to) if to else -1

    def match(self, word: str) -> tuple[float, bool]:
        """(weight, whether spelt as in the lexicon) of a word; no match weighs 0."""
        return self.find(word)[:2]

    def find(self, word: str) -> tuple[float, bool, str]:
        """As ``match``, with the term or stem."""
        if word in self.terms:
            return self.terms[word], True, word
        for n in STEM_LENGTHS:
            if word[:n] in self.stems:
                return self.stems[word[:n]], True, word[:n]
        if len(self.steps) > self.MEMO:
            self._reset()
        state = self.start
        for ch in word:
            key = (state, ch if ch in self.alphabet else "\0")
            state = self.steps.get(key)
            if state is None:
                state = self.steps[key] = self._step(*key)
            if state < 0:
                return 0.0, False, ""
        best = [(e, -self.terms[self.term[node]], self.term[node]) for node, e in self.states[state] if self.term[node] is not None and e <= self.edits[self.term[node]]]
        return (-min(best)[1] * MISSPELT, False, min(best)[2]) if best else (0.0, False, "")


@functools.lru_cache(maxsize=200_000)
def hash_of(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


_automata: dict[int, LexiconAutomaton] = {}


def automaton(terms: dict[str, float], stems: dict[str, float], rigid: frozenset[str] = frozenset()) -> LexiconAutomaton:
    """One a worker, kept between tasks."""
    key = hash((tuple(sorted(terms.items())), tuple(sorted(stems.items())), rigid))
    if key not in _automata:
        if len(_automata) > 3:
            _automata.clear()
        _automata[key] = LexiconAutomaton(terms, stems, rigid)
    return _automata[key]


def learn(docs: DataFrame, labels: DataFrame, held_out) -> tuple[dict[str, float], dict[str, float], frozenset[str], set[str]]:
    """(terms, stems, terms that must be spelt exactly, innocent words near others) from labelled rows that aren't held out.

    At most ``LABELLED_ROWS`` labels, chosen by a hash of the id, are learnt from; of their words those
    that are terms or stems, all of them, reach the driver. Null labels or ids don't count; a document labelled more than once
    is toxic if any label is.
    """
    ship(docs.sparkSession)
    flags = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~F.coalesce(held_out, F.lit(False)))
    flags = flags.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    flags = flags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    known = docs.select("doc_id", "text").join(F.broadcast(flags), "doc_id")

    def count(batches):
        for b in row_slices(batches, 0):
            w = BatchWords(b.column(0))
            toxic = b.column(1).to_numpy()
            k = max(len(w.letters), 1)
            pair = np.unique(w.doc * k + w.of)
            clean = toxic[pair // k] == 0
            c = np.bincount(pair[clean] % k, minlength=k)
            t = np.bincount(pair[~clean] % k, minlength=k)
            prior = np.where(np.r_[True, w.doc[1:] != w.doc[:-1]], 0, np.r_[0, w.of[:-1] + 1])
            bad = toxic[w.doc] == 1 if len(w.doc) else np.zeros(0, bool)
            after = np.unique(w.of[bad] * (k + 1) + prior[bad])
            names = pa.array(w.letters, pa.string())
            hashes = np.array([0] + [hash_of(x) for x in w.letters], np.int64)
            word = np.r_[np.arange(len(w.letters)), after // (k + 1)]
            none = np.zeros(len(after), np.int64)
            before = pa.array(np.r_[np.zeros(len(w.letters), np.int64), hashes[after % (k + 1)]], mask=np.r_[np.ones(len(w.letters), bool), np.zeros(len(after), bool)])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(word)), pa.array(np.r_[t[: len(w.letters)], none]), pa.array(np.r_[c[: len(w.letters)], none]), before], ["word", "t", "c", "before"])

    n_toxic, n_all = flags.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n_all:
        return {}, {}, frozenset(), set()
    odds = (n_all - n_toxic) / n_toxic
    words = known.select("text", "toxic").mapInArrow(count, "word string, t long, c long, before long").where("length(word) >= 3")
    words = words.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_distinct("before").alias("contexts"))
    purity = (F.col("t") * odds + 0.5) / (F.col("t") * odds + F.col("c") + 1.0)
    words = Workspace(docs.sparkSession).save(words.withColumn("purity", purity))
    # so many contexts that chance gives not one word of the vocabulary as many in toxic documents only
    least = max(MIN_CONTEXTS, math.ceil(math.log(max(words.count(), 2)) / math.log(n_all / n_toxic)) + 1)
    few = max(3, least - 3)
    good = (F.least("t", "contexts") >= few) & (F.col("t") >= 10 * F.col("c")) & (F.col("purity") >= PURITY)
    found = words.where(good).collect()
    terms = {r.word: min(r.purity, 0.97) if min(r.t, r.contexts) >= least else WEAK for r in found}
    stem = words.select(F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS])).alias("stem"), F.least("t", "contexts").alias("t"), "c").where("stem is not null")
    stem = stem.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") >= 2).alias("n"))
    good_stem = (F.col("n") >= STEM_WORDS) & (F.col("t") >= 2 * least) & (F.col("t") >= 20 * F.col("c"))
    stems = {r.stem: 0.9 for r in stem.where(good_stem).collect()}
    clean = words.where("c > 0 and t < 10 * c").select("word")

    def near(batches):
        for b in batches:
            own = automaton(terms, stems)
            got = [(x, own.find(x)) for x in b.column(0).to_pylist()]
            got = [(x, y[2]) for x, y in got if y[0] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.string())], ["word", "term"])

    # terms with ordinary words beside them aren't matched loosely; the others' few are known
    crowd = clean.mapInArrow(near, "word string, term string").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("word"))
    crowd = crowd.collect()
    rigid = frozenset(r.term for r in crowd if r.n > 1)
    return terms, stems, rigid, {r.word for r in crowd if r.n == 1}


#: Ends of paragraphs and marks of quotation, by family.
_MARK = {
    "straight": re.compile(rb'\n[ \t\r\x0b\x0c]*\n|"'),
    "curly": re.compile(rb"\n[ \t\r\x0b\x0c]*\n|\xe2\x80[\x9c-\x9e]"),
    "angle": re.compile(rb"\n[ \t\r\x0b\x0c]*\n|\xc2[\xab\xbb]"),
    "single angle": re.compile(rb"\n[ \t\r\x0b\x0c]*\n|\xe2\x80[\xb9\xba]"),
}
_LOW, _LEFT, _RIGHT = "\u201e".encode(), "\u201c".encode(), "\u201d".encode()
#: What may precede a word's first letter.
_LEADING = re.compile(rb"(?:[^\x80-\xff\w]|\xe2\x80.|\xc2[\xa1\xab\xbb\xbf])*", re.S)
_WORDLIKE = re.compile(rb"[\w\x80-\xff]")


def _role(data: bytes, mark: re.Match, kind: str, opened: bytes | None) -> str:
    """What a mark does: open, close, either, or inch, which closes only where nothing better does."""
    m, before, after = mark[0], data[mark.start() - 1 : mark.start()] if mark.start() else b"", data[mark.end() : mark.end() + 1]
    opens = bool(_WORDLIKE.match(after)) and not _WORDLIKE.match(before)
    if kind == "straight":
        if opens:
            return "open"
        if before.strip() and not _WORDLIKE.match(after):
            return "inch" if before.isdigit() else "close"
        return "inch" if before.isdigit() else "either"
    if kind == "curly":
        if m == _LOW or m == _LEFT and opened != _LOW:
            return "open"
        return "close" if opened else "open" if opens else "close"
    if opened:
        return "close" if m != opened else "open"
    # the marks point outwards in French and Spanish, inwards in most German prints
    return "open" if m in (b"\xc2\xab", b"\xe2\x80\xb9") or opens else "close"


def quotations(data: bytes) -> list[list[tuple[int, int]]]:
    """Quoted spans of a text (places of the opening and the closing mark), a list a family of marks.

    One pass a family: a mark opens or closes by the letters and spaces beside it. A mark that
    no other answers in its paragraph, or before the next opening mark, is stray and quotes nothing;
    one after a digit may be an inch mark, so it closes only if no other mark does.
    """
    out = []
    for kind, pattern in _MARK.items():
        spans, at, opened, inch = [], -1, None, -1
        for mark in pattern.finditer(data):
            role = "end" if mark[0][:1] == b"\n" else _role(data, mark, kind, opened)
            if role == "either":
                role = "close" if opened else "open"
            if role == "close" and opened:
                spans.append((at, mark.start()))
                opened, inch = None, -1
            elif role == "inch" and opened and inch < 0:
                inch = mark.start()
            elif role in ("open", "end"):
                if opened and inch >= 0:
                    spans.append((at, inch))
                at, opened, inch = (mark.start(), mark[0], -1) if role == "open" else (-1, None, -1)
        if opened and inch >= 0:
            spans.append((at, inch))
        out.append(spans)
    return out


def is_quoted(spans: list[list[tuple[int, int]]], at: int) -> bool:
    for own in spans:
        k = bisect.bisect_right(own, (at,)) - 1
        if k >= 0 and own[k][0] < at < own[k][1]:
            return True
    return False


def toxicity(docs: DataFrame, lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted and n_hits of each row of ``docs``.

    The score is the chance that at least one hit is abuse: hits are taken as independent, and
    a text without hits, so also a null or empty one, has the least score ``BASE``. Each row is by
    itself: repeated rows give repeated results, an empty table an empty one; other columns
    are not read.
    """
    terms, stems, rigid, innocent = lexicon
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in row_slices(batches, 1):
            own = automaton(terms, stems, rigid)
            w = BatchWords(b.column(1))
            weight, spelt = np.zeros(len(w.letters)), np.zeros(len(w.letters), bool)
            for k, x in enumerate(w.letters):
                if len(x) >= 3 and x not in innocent:
                    weight[k], spelt[k] = own.match(x)
            hits = np.flatnonzero(weight[w.of] > 0)
            miss, n_hits = np.full(len(b), 1 - BASE), np.zeros(len(b), np.int64)
            known = -1
            for i, h in enumerate(hits):
                doc = w.doc[h]
                if doc != known:  # hits come by document
                    known, base = doc, w.offsets[doc]
                    data = w.buf[base : w.offsets[doc + 1]].tobytes()
                    spans = quotations(data)
                near = any(0 <= k < len(hits) and w.doc[hits[k]] == doc and abs(hits[k] - h) <= WINDOW for k in (i - 1, i + 1))
                p = weight[w.of[h]]
                if near and not spelt[w.of[h]]:
                    p = p * CLUSTERED / MISSPELT
                letter = _LEADING.match(data, w.start[h] - base, w.end[h] - base).end()
                prior = [w.letters[w.of[k]] for k in range(max(0, h - 4), h) if w.doc[k] == doc]
                if is_quoted(spans, letter) or any(x in REPORTING for x in prior):
                    p *= QUOTED
                miss[doc] *= 1 - p
                n_hits[doc] += 1
            score = 1 - miss
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(n_hits)], ["doc_id", "score", "predicted", "n_hits"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, score double, predicted int, n_hits long")
