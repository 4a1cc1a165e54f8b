"""LM scoring: Brown class-based bigrams.

Exchange clustering moves words between classes while the likelihood of class bigrams
grows. The most frequent words are first exchanged one by one over their bigram counts; all others
are dealt to groups by hash. Then every word of the corpus, frequent or not, moves in distributed
exchange steps over all of its contexts (classes of its neighbours now, the end included), until
a step raises the likelihood by next to nothing. A token's probability is that of its class
after the class before it times that of the word in its class.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from gridweave.llm.arrays import LOWER, U, Hasher, as_large, buffer_of, slices, word_spans
from gridweave.llm.exchange import ANSWER, SENT, Blocks, as_table, bucket_of, dealt_out, groups, judge_bits, read_bits, send
from gridweave.workspace import Workspace

#: Words that are exchanged one by one on the driver to begin with and classes that they begin in,
#: for a corpus of up to ``SMALL`` bytes; both grow with larger ones, by the sixth and the fourth root.
FREQUENT, CLASSES, SMALL = 1000, 32, 1 << 27
#: More classes: all other words begin in these, dealt by hash, for words that begin alike move alike.
GROUPS = 8
#: Exchange steps go on while one raises the likelihood by so much a token (natural logarithm).
LEAST_RISE = 0.02
#: Pseudo-counts that draw a class's successors to the classes' overall shares.
TRANSITION_PRIOR = 5.0
#: A block's words times classes up to which contexts are counted in a table.
DENSE = 1 << 24
_END = U(0x0E4D0E4D0E4D0E4D)
_COUNT, _GROUP, _FACTS, _TOP = 1, 2, 8, 9


def encode(table: pa.Table) -> pa.Table:
    """A block's texts as token numbers: ``tokens`` of each document, ``types`` (their hashes) in the first row.

    Tokens are the words of each document, A-Z lower-cased, then one end.
    """
    buf, offsets = buffer_of(as_large(table.column("text")))
    keys, docs = [], []
    for i, j in slices(offsets):
        data = LOWER[buf[offsets[i] : offsets[j]]]
        s, e, t = word_spans(data, offsets[i : j + 1] - offsets[i])
        keys.append(Hasher(data).spans(s, e))
        docs.append(t + i)
    word, doc = np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(docs or [np.zeros(0, np.int64)])
    n_docs = len(offsets) - 1
    key = np.full(len(word) + n_docs, _END, U)
    key[np.arange(len(word)) + doc] = word
    order, first, types = groups(key)
    number = np.empty(len(order), np.uint32)
    number[order] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.r_[first, len(order)]))
    ends = np.r_[0, 4 * np.cumsum(np.bincount(doc, minlength=n_docs) + 1)].astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(ends), pa.py_buffer(number.tobytes())])
    said = pa.array([types.tobytes()] + [b""] * (n_docs - 1), pa.binary())
    return pa.table([*(table.column(c) for c in ("block", "doc_id", "train")), tokens, said], names=["block", "doc_id", "train", "tokens", "types"])


class Tokens:
    """A block's tokens in order, as numbers of its types, and the types' hashes in ascending order."""

    def __init__(self, table: pa.Table):
        raw, offsets = buffer_of(as_large(table.column("tokens")))
        self.block = int(table.column("block")[0].as_py())
        self.types = np.frombuffer(max((x.as_py() for x in table.column("types")), key=len), U)
        self.type = np.frombuffer(raw.tobytes(), np.uint32).astype(np.int64)
        self.n = np.diff(offsets) // 4
        self.first = np.cumsum(self.n) - self.n
        self.train = np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(bool), self.n)

    def count(self) -> np.ndarray:
        """Training tokens of each type."""
        return np.bincount(self.type[self.train], minlength=len(self.types))

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """What ``x`` says of the token before; the end comes before a document's first."""
        return np.r_[np.asarray([start], x.dtype), x[:-1]] if len(x) else x


def _sums(order, first, vals):
    """Per element, the sum of its group."""
    out = np.empty_like(vals)
    out[order] = np.repeat(np.add.reduceat(vals[order], first, axis=0), np.diff(np.r_[first, len(order)]), axis=0)
    return out


def exchange_clusters(bigrams: np.ndarray, free: int, classes: int, fixed: int, rounds: int = 12) -> np.ndarray:
    """Classes of the first ``free`` words of a square table of bigram counts.

    The other ``fixed`` words have the classes after ``classes``. Words start by frequency in
    turn; each is then moved to the class that raises the likelihood of class bigrams most,
    until a round moves none. Ties stay or go to the first class, so reruns agree.
    """
    n = free + fixed
    c = np.r_[np.arange(free) % classes, classes + np.arange(fixed)]
    k = classes + fixed
    table = np.zeros((k, k))
    np.add.at(table, (np.repeat(c, n), np.tile(c, n)), bigrams.ravel())
    total = bigrams.astype(float)
    left, right = total.sum(0), total.sum(1)
    nlogn = lambda x: x * np.log(np.maximum(x, 1e-300))
    eye = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(free):
            if not left[w] + right[w]:
                continue
            after, prior, own = np.bincount(c, weights=total[w], minlength=k), np.bincount(c, weights=total[:, w], minlength=k), total[w, w]
            a = c[w]
            after[a] -= own
            prior[a] -= own
            table[a] -= after
            table[:, a] -= prior
            table[a, a] -= own
            rows, cols = table[:classes], table[:, :classes].T
            gain = nlogn(rows + after) - nlogn(rows) + nlogn(cols + prior) - nlogn(cols)
            gain[eye, eye] = 0
            d = table[eye, eye]
            score = gain.sum(1) + nlogn(d + after[:classes] + prior[:classes] + own) - nlogn(d)
            r, l = table.sum(1)[:classes], table.sum(0)[:classes]
            score -= nlogn(r + right[w]) - nlogn(r) + nlogn(l + left[w]) - nlogn(l)
            b = int(np.argmax(score)) if score.max() > score[a] + 1e-9 else a
            table[b] += after
            table[:, b] += prior
            table[b, b] += own
            c[w] = b
            moved += a != b
        if not moved:
            break
    return c


class Model:
    """First classes of words, transition and emission tables; as large as the classes and the frequent words."""

    def __init__(self, n_tokens, n_types, words, fine, _coarse=None, classes=CLASSES):
        self.n_tokens, self.n_types = n_tokens, n_types
        order = np.argsort(words)
        self.words, self.fine = words[order], fine[order]
        self.end, self.rare = classes, classes + 1
        self.size = classes + 1 + GROUPS

    def frequent(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words, whether there)."""
        if not len(self.words):
            return np.zeros(len(types), np.int64), np.zeros(len(types), bool)
        at = np.minimum(np.searchsorted(self.words, types), len(self.words) - 1)
        return at, self.words[at] == types

    def classes(self, types, group) -> np.ndarray:
        """First class of each type: fine, end, or the class of its group."""
        at, there = self.frequent(types)
        out = self.rare + group.astype(np.int64)
        out[there] = self.fine[at[there]]
        out[types == _END] = self.end
        return out

    def fit(self, bigrams: np.ndarray, once: np.ndarray) -> None:
        size = bigrams.sum(0)
        share = (size + 0.5) / (size.sum() + 0.5 * self.size)
        step = (bigrams + TRANSITION_PRIOR * share) / (bigrams.sum(1, keepdims=True) + TRANSITION_PRIOR)
        unseen = (once + 0.5) / (size + 1)
        unseen[self.end] = 0
        self.class_size, self.keep = np.maximum(size, 1), 1 - unseen
        self.log_step = np.log10(step)
        new = step * unseen
        self.log_new = np.log10(new.sum(1))
        self.new_class = np.argmax(new, axis=1)

    def score(self, cls, count) -> np.ndarray:
        """log10 probability of each token of consecutive documents, from its class and training count."""
        seen = count > 0
        last = np.maximum.accumulate(np.where(seen, np.arange(len(cls)), -1))
        prior_seen = np.r_[-1, last[:-1]]
        anchor = np.where(prior_seen >= 0, cls[np.maximum(prior_seen, 0)], self.end)
        cls = np.where(seen, cls, self.new_class[anchor])
        before = np.r_[self.end, cls[:-1]] if len(cls) else cls
        known = self.log_step[before, cls] + np.log10(self.keep[cls] * np.maximum(count, 1) / self.class_size[cls])
        return np.where(seen, known, self.log_new[before])


def _nlogn(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray) -> float:
    """The part of a training text's log likelihood that the words' classes change."""
    return float(_nlogn(bigrams).sum() - _nlogn(bigrams.sum(1)).sum() - _nlogn(bigrams.sum(0)).sum())


def best_classes(own: np.ndarray, word: np.ndarray, cell: np.ndarray, count: np.ndarray, bigrams: np.ndarray, end: int, chunk: int = 20_000) -> np.ndarray:
    """Class of each word, after the step that raises the likelihood most were it to move alone.

    ``own`` is each word's class; ``cell`` is the class of a neighbour before, or the number of classes
    plus that of one after, and ``count`` how often, ascending by ``word``.
    """
    size = len(bigrams)
    sides = np.concatenate([bigrams, bigrams.T]).astype(float)  # by cell: classes beside it
    margins = bigrams.sum(0).astype(float), bigrams.sum(1).astype(float)
    small_base = _nlogn(sides)
    small = [_nlogn(sides + k) - small_base for k in range(1, 5)]  # what most counts add
    bars = margins[0] + margins[1] == 0  # all would move to an empty class together
    bars[end] = True
    out = own.copy()
    edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    at = 0
    while at < len(edges):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + chunk)))
        a, b = edges[at], edges[to] if to < len(edges) else len(word)
        n, w, c = count[a:b].astype(float), word[a:b], cell[a:b]
        starts, ws = edges[at:to] - a, word[edges[at:to]]
        rows, mine = np.arange(b - a), own[w]
        rises = np.empty((b - a, size))
        for k, table in enumerate(small, 1):
            few = n == k
            rises[few] = table[c[few]]
        many = np.flatnonzero(n > len(small))
        rises[many] = _nlogn(sides[c[many]] + n[many, None]) - small_base[c[many]]
        at_home = sides[c, mine] - n
        rises[rows, mine] = _nlogn(at_home + n) - _nlogn(at_home)
        gain = np.add.reduceat(rises, starts, axis=0)
        rows, mine = np.arange(len(ws)), own[ws]
        for k, margin in enumerate(margins):
            total = np.add.reduceat(np.where(c // size == k, n, 0.0), starts)
            base = np.tile(margin, (len(ws), 1))
            base[rows, mine] -= total
            gain -= _nlogn(base + total[:, None]) - _nlogn(base)
        gain[:, bars] = -np.inf
        best = np.argmax(gain, axis=1)
        out[ws] = np.where(gain[rows, best] > gain[rows, mine] + 1e-9, best, mine)
        at = to
    return out


def _cells(row: np.ndarray, col: np.ndarray, width: int) -> pa.Table:
    cell, n = np.unique(row * width + col, return_counts=True)
    return pa.table([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])


def _collect_cells(df: DataFrame, width: int, height: int) -> np.ndarray:
    """Summed cells of a table whose size is a parameter's, not the corpus's."""
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(width * height, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(height, width)


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts by a class bigram model learnt from the rows that ``held_out`` isn't true of.

    Returns one row per input row: doc_id, held_out, n_tokens, n_known (tokens that training
    has), train_tokens, base_score (additively smoothed unigrams), score (the class model)
    and perplexity, logarithms to base 10. Null texts count as empty and consist of the end.
    A null ``held_out`` counts as false. Words that training lacks are one type, as in the
    base. Repeated rows count, and are scored, each; without training rows all words are
    unseen; an empty table gives an empty result; other columns are not read.
    """
    ws = Workspace(docs.sparkSession)
    flag = F.coalesce(held_out, F.lit(False))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~flag).alias("train"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    kinds = [StructField("block", IntegerType()), *narrow.select("doc_id", "train").schema, StructField("tokens", BinaryType()), StructField("types", BinaryType())]
    blocks = Blocks(narrow, ws, encode, StructType(kinds))
    n = blocks.n_buckets
    most = int(FREQUENT * max(1.0, blocks.bytes / SMALL) ** (1 / 6))
    n_classes = int(CLASSES * max(1.0, blocks.bytes / SMALL) ** (1 / 4))

    def ask_counts(table, _):
        t = Tokens(table)
        return as_table(send(t.block, _COUNT, n, t.types, t.count().astype(np.int64)))

    def judge_counts(table):
        facts = []

        def verdict(kind, order, first, vals):
            out = _sums(order, first, vals)
            keys = np.concatenate([np.frombuffer(x.as_py(), U) for x in table.column("keys")])
            each, total = keys[order][first], out[order][first]
            top = np.lexsort((each, -total))[: most + 1]
            facts.append((-1, 0, _FACTS, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
            facts.append((-1, 0, _TOP, each[top].tobytes() + total[top].tobytes()))
            return out

        said = judge_bits(table, verdict, {}, {_COUNT: np.int64})
        return pa.concat_tables([said, as_table(facts, ["block", "bucket", "kind", "bits"])])

    counts = blocks.ask(ask_counts, judge_counts)

    def unpack(batches):
        for b in batches:
            kind, key, num = [], [], []
            for k, raw in zip(b.column("kind").to_pylist(), b.column("bits").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64)
                half = len(x) // 2
                kind.append(np.full(half, k))
                key.append(x[:half])
                num.append(x[half:])
            cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(v).astype(np.int64)) for v in (kind, key, num)], ["kind", "key", "num"])

    facts = counts.where("block = -1").mapInArrow(unpack, "kind long, key long, num long")
    n_tokens, n_types = facts.where(F.col("kind") == _FACTS).agg(F.coalesce(F.sum("key"), F.lit(0)), F.coalesce(F.sum("num"), F.lit(0))).first()
    signed_end = int(np.array([_END], U).view(np.int64)[0])
    top = facts.where((F.col("kind") == _TOP) & (F.col("num") > 0) & (F.col("key") != signed_end)).orderBy(F.desc("num"), "key").limit(most).toPandas()
    words = top["key"].to_numpy(np.int64).view(U)
    answers = counts.where("block >= 0")

    free = len(words)
    ranked = np.argsort(words)
    width = free + 2

    def places(t: Tokens) -> np.ndarray:
        """By type: place by frequency, then the end and the rest as one."""
        if not free:
            return np.where(t.types == _END, 0, 1)
        at = np.minimum(np.searchsorted(words[ranked], t.types), free - 1)
        place = np.where(words[ranked][at] == t.types, ranked[at], free + 1)
        place[t.types == _END] = free
        return place

    def word_bigrams(table, _):
        t = Tokens(table)
        x = places(t)[t.type]
        return _cells(t.before(x, free)[t.train], x[t.train], width)

    # the driver gets counts between frequent words only, a number that grows by the cube root of the corpus at most
    bigrams = _collect_cells(blocks.map(word_bigrams, "cell long, n long"), width, width)
    fine = exchange_clusters(bigrams, free, n_classes, 2)[:free]
    model = Model(int(n_tokens), int(n_types), words, fine, classes=n_classes)
    size, end = model.size, model.end

    def with_classes(table, said, moved):
        """Tokens, training count of each type in the corpus, class of each type, which types are words."""
        t = Tokens(table)
        count = read_bits(said, _COUNT, n, t.types, np.int64)
        own = np.flatnonzero(t.types != _END)
        if moved:
            cls = np.full(len(t.types), end, np.int64)
            cls[own] = read_bits(said, _GROUP, n, t.types[own], np.uint16)
        else:
            cls = model.classes(t.types, (t.types >> U(40)) % U(GROUPS))
        return t, count, cls, own

    def ask_contexts(table, said, moved):
        """Each word's class, whether it occurs once, and how often which class is beside it in training."""
        t, count, cls, own = with_classes(table, said, moved)
        x = cls[t.type]
        word = np.flatnonzero(t.train & (t.types != _END)[t.type])
        row, width = t.type[word] * (2 * size), len(t.types) * 2 * size
        key = np.r_[row + t.before(x, end)[word], row + size + np.r_[x[1:], [end]][word]]
        if width <= DENSE:
            times = np.bincount(key, minlength=width)
            cells = np.flatnonzero(times)
            times = times[cells]
        else:
            cells, times = np.unique(key, return_counts=True)
        of = cells // (2 * size)
        bucket = bucket_of(t.types, n)
        order, cuts = dealt_out(bucket[of], n)
        rows, kinds_of = [], np.bincount(of, minlength=len(t.types))
        o_order, o_cuts = dealt_out(bucket[own], n)
        for row in send(t.block, _GROUP, n, t.types[own], cls[own].astype(np.uint16)):
            mine = own[o_order[o_cuts[row[1]] : o_cuts[row[1] + 1]]]  # ascending, as the row's keys
            part = order[cuts[row[1]] : cuts[row[1] + 1]]
            told = (cls[mine].astype(np.uint16), count[mine] == 1, kinds_of[mine].astype(np.int32), (cells[part] % (2 * size)).astype(np.uint16), times[part].astype(np.uint32))
            rows.append((*row[:4], pickle.dumps(told, 5)))
        return as_table(rows)

    def add_contexts(table):
        """A bucket's words with summed contexts, and its part of the class bigrams."""
        keys = [np.frombuffer(x.as_py(), U) for x in table.column("keys")]
        told = [pickle.loads(x.as_py()) for x in table.column("vals")]
        types, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.cumsum([0, *map(len, keys)])
        own, once = np.zeros(len(types), np.int64), np.zeros(len(types), bool)
        own[inverse], once[inverse] = np.concatenate([x[0] for x in told]), np.concatenate([x[1] for x in told])
        key = np.concatenate([np.repeat(inverse[a:b], x[2]) * (2 * size) + x[3] for a, b, x in zip(cuts[:-1], cuts[1:], told, strict=True)])
        order, first, cells = groups(key)
        count = np.concatenate([x[4] for x in told]).astype(np.int64)[order]
        count = np.add.reduceat(count, first) if len(first) else count
        word, cell = cells // (2 * size), cells % (2 * size)
        right, ahead = cell >= size, cell == end
        at = np.r_[own[word[right]] * size + cell[right] - size, end * size + own[word[ahead]], size * size + own[once]]
        add = np.bincount(at.astype(np.int64), np.r_[count[right], count[ahead], np.ones(int(once.sum()))], size * (size + 1)).astype(np.int64)
        some = np.flatnonzero(add)
        kept = (own.astype(np.uint16), word.astype(np.int32), cell.astype(np.uint16), count, table.column("block").to_pylist(), [inverse[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "facts": [some.astype(np.int64).tobytes() + add[some].tobytes()], "words": [pickle.dumps(kept, 5)]})

    def facts_of(batches):
        for b in batches:
            parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in b.column("facts").to_pylist()]
            both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["cell", "n"])

    def moves(table_of_bigrams):
        def run(batches):
            for b in batches:
                for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), strict=True):
                    own, word, cell, count, asked, places_of = pickle.loads(raw)
                    cls = best_classes(own.astype(np.int64), word, cell.astype(np.int64), count, table_of_bigrams, end).astype(np.uint16)
                    yield from as_table([(k, bucket, _GROUP, cls[x].tobytes()) for k, x in zip(asked, places_of, strict=True)], ["block", "bucket", "kind", "bits"]).to_batches()

        return run

    n_docs = narrow.where("train").count()
    best, moved = None, None
    while True:
        said = answers if moved is None else answers.unionByName(moved)
        known = moved is not None
        sent = blocks.map(lambda table, got, known=known: ask_contexts(table, got, known), SENT, said)
        step = ws.save(sent.groupBy("bucket").applyInArrow(add_contexts, "bucket int, facts binary, words binary"))
        sums = _collect_cells(step.select("facts").mapInArrow(facts_of, "cell long, n long"), size, size + 1)
        sums[end, end] = n_docs - sums[:size, end].sum()  # texts without words
        new = likelihood(sums[:size].astype(float)) / max(1, model.n_tokens), sums, moved
        rise = new[0] - best[0] if best else np.inf
        if rise > 0:
            if best and best[2] is not None:
                ws.drop(best[2])
            best = new
        if rise < LEAST_RISE or not model.n_tokens:
            break
        moved = ws.save(step.select("bucket", "words").mapInArrow(moves(sums[:size]), ANSWER))
        ws.drop(step)
        del sent, step, said
        ws.release()
    _, sums, moved = best
    said = answers if moved is None else answers.unionByName(moved)
    model.fit(sums[:size].astype(float), sums[size].astype(float))
    base_total = np.log10(model.n_tokens + 0.5 * (model.n_types + 1))

    has_moved = moved is not None

    def last(table, said):
        t, count, cls, _ = with_classes(table, said, has_moved)
        c = count[t.type]
        per = lambda x: np.add.reduceat(x, t.first)
        base, score = per(np.log10(c + 0.5) - base_total), per(model.score(cls[t.type], c))
        train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
        cols = [pa.array(~train), pa.array(t.n), pa.array(per((c > 0).astype(np.int64))), pa.array(np.full(len(t.n), model.n_tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / t.n))]
        return pa.table([table.column("doc_id"), *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return ws.finish(blocks.map(last, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", said))
