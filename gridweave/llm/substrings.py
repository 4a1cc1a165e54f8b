"""Suffix-array dedup: a radix sort of suffixes that stops at the threshold length.

A sieve comes first: windows of the threshold length are gathered to runs that share their
anchor, the 20 bytes of least hash inside them. Equal windows have equal anchors, so a run
whose anchor one document alone has holds no repeat, and its suffixes end there. All others are
dealt by anchor to buckets with the bytes that their windows cover, and are ordered there by
passes over digits of eight bytes, most significant first; a suffix that has no equal left
isn't looked at again. Groups that are equal through the threshold are exactly the
repeated windows; each keeps the smallest id. An anchor with more runs than a bucket should hold has its
windows dealt one by one. Hashes only deal rows out and sieve them; what is equal is told by bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from gridweave.llm.arrays import SLICE_BYTES, U, Hasher, as_large, buffer_of, slices
from gridweave.llm.exchange import ANSWER, SENT, Blocks, as_table, bucket_of, dealt_out, groups, judge_bits, pack_keys, read_bits, relaxed, send, unpack_keys
from gridweave.workspace import Workspace

#: Bytes of an anchor, and windows of a run at most.
ANCHOR, RUN = 20, 32
#: Distinct runs of an anchor, over all blocks, from which its windows are dealt one by one.
CROWD = 4096
#: Runs that a bucket orders at a time; groups aren't divided.
ORDERED = 20_000
#: Anchors are sent as so many bytes of their hash: a chance equal costs work and no result.
SHORT = 5
_MASK = U((1 << 8 * SHORT) - 1)
_NULL_ID = np.iinfo(np.int64).max
_SIEVE, _WHOLE, _SINGLE = 1, 2, 3


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, x
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def pieces(buf: np.ndarray, offsets: np.ndarray, width: int):
    """(bytes, offsets, first document, bytes before) of bounded stretches; each window lies in one."""
    for i, j in slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * SLICE_BYTES:
            yield buf[a:b], offsets[i : j + 1] - a, i, 0
            continue
        for s in range(a, max(a + 1, b - width + 1), SLICE_BYTES):
            e = min(b, s + SLICE_BYTES + width - 1)
            yield buf[s:e], np.array([0, e - s]), i, s - a


class Runs:
    """All runs of windows of a block: consecutive windows of a document with the same anchor, ``RUN`` at most.

    ``anchor`` and ``whole`` are hashes of the anchor and of all bytes of the run; ``at`` is its
    place in the block's bytes and ``length`` its windows.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, width: int):
        parts, size = [], min(ANCHOR, width)
        for data, offs, first, ahead in pieces(buf, offsets, width):
            if len(data) < width:
                continue
            hasher = Hasher(data)
            anchor = _window_min(hasher.windows(size), width - size + 1)
            n_of = np.maximum(np.diff(offs) - width + 1, 0)
            doc = np.repeat(np.arange(len(n_of)), n_of)
            if not len(doc):
                continue
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n_of) - n_of, n_of) + offs[:-1][doc]
            a = anchor[at]
            start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
            length = np.diff(np.r_[start, len(at)])
            cuts = -(-length // RUN)
            if cuts.max() > 1:
                step = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = np.repeat(start, cuts) + step * RUN
                length = np.minimum(np.repeat(length, cuts) - step * RUN, RUN)
            s = at[start]
            whole = hasher.spans(s, s + length - 1 + width)
            parts.append((a[start], whole, doc[start] + first, s + int(offsets[first]) + ahead, length))
        z = [np.zeros(0, U)] * 2 + [np.zeros(0, np.int64)] * 3
        self.anchor, self.whole, self.doc, self.at, self.length = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else z


class Suffixes:
    """Suffixes of a byte buffer, each of a length of its own, with digits of eight bytes."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        padded = np.r_[buf, np.zeros(8, np.uint8)]
        self.words = np.ndarray(len(buf) + 1, ">u8", padded, strides=(1,))  # at every byte, unaligned
        self.starts, self.lengths, self.last = starts, lengths, len(buf)

    def digit(self, k: int, rows: np.ndarray) -> np.ndarray:
        left = np.clip(self.lengths[rows] - 8 * k, 0, 8)
        x = self.words[np.minimum(self.starts[rows] + 8 * k, self.last)].astype(U)
        short = left < 8
        if short.any():
            x = np.where(left > 0, x >> (U(8) * np.minimum(8 - left, 7).astype(U)), U(0))
        return x


def radix_groups(group: np.ndarray, suffixes: Suffixes) -> np.ndarray:
    """Labels that are equal where ``group`` and all bytes of the suffix are; equal groups have equal lengths.

    Passes go from the most significant digit on, and a pass orders only groups of several
    suffixes whose digits differ.
    """
    order, first, _ = groups(group)
    size = np.diff(np.r_[first, len(order)])
    label = np.empty(len(order), np.int64)
    label[order] = np.repeat(np.arange(len(first)), size)
    fresh = len(first)
    live = order[np.repeat(size > 1, size)]  # by group
    n_digits = -(-int(suffixes.lengths.max(initial=0)) // 8)
    for k in range(n_digits):
        if not len(live):
            break
        digit, own = suffixes.digit(k, live), label[live]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, len(own)])
        mixed = np.repeat(np.minimum.reduceat(digit, first) != np.maximum.reduceat(digit, first), size)
        if not mixed.any():
            continue
        rows, digit, own = live[mixed], digit[mixed], own[mixed]
        order = np.lexsort((digit, own))
        rows, digit, own = rows[order], digit[order], own[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])]
        label[rows] = fresh + np.cumsum(new) - 1
        first = np.flatnonzero(new)
        fresh += len(first)
        size = np.diff(np.r_[first, len(rows)])
        live = np.r_[live[~mixed], rows[np.repeat(size > 1, size)]]
    return label


def _least(label: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """Per row, the least value of the rows with its label."""
    order, first, _ = groups(label)
    out = np.empty_like(vals)
    low = np.minimum.reduceat(vals[order], first) if len(first) else vals
    out[order] = np.repeat(low, np.diff(np.r_[first, len(order)]))
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... up to lengths[i] of them, for all i in turn."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)


def gone_windows(anchor: np.ndarray, n_windows: np.ndarray, ids: np.ndarray, buf: np.ndarray, width: int) -> np.ndarray:
    """A bit per window of each run: whether a run with a smaller id has that window too.

    The runs' bytes follow each other in ``buf``; runs with different anchors share no window.
    """
    out = np.zeros(len(anchor), np.uint32)
    size = n_windows + width - 1
    begin = np.cumsum(size) - size
    by_anchor = np.argsort(anchor, kind="stable")
    edge = np.flatnonzero(np.r_[True, anchor[by_anchor][1:] != anchor[by_anchor][:-1]])
    edge = np.r_[edge, len(by_anchor)] if len(by_anchor) else np.zeros(1, np.int64)
    k = 0
    while k < len(edge) - 1:
        to = max(k + 1, int(np.searchsorted(edge, edge[k] + ORDERED, "right")) - 1)
        own = by_anchor[edge[k] : edge[to]]
        k = to
        n, i = n_windows[own], ids[own]
        part = buf[_spread(begin[own], size[own])]
        start = np.cumsum(size[own]) - size[own]
        # whole runs first: of equal ones all windows but the smallest id's go
        run = radix_groups(anchor[own] << U(6) | n.astype(U), Suffixes(part, start, size[own]))
        low = _least(run, i)
        gone = low < i
        # then the windows of different runs with one anchor
        rep = np.unique(run, return_index=True)[1]
        order, first, _ = groups(anchor[own][rep])
        rep = rep[order[np.repeat(np.diff(np.r_[first, len(order)]) > 1, np.diff(np.r_[first, len(order)]))]]
        bits = np.where(gone, (U(1) << n.astype(U)) - U(1), U(0))
        if len(rep):
            w_run, w_at = np.repeat(rep, n[rep]), _spread(start[rep], n[rep])
            window = radix_groups(anchor[own][w_run], Suffixes(part, w_at, np.full(len(w_at), width)))
            w_low = _least(window, low[w_run])
            step = U(1) << (w_at - start[w_run]).astype(U)
            first = np.cumsum(n[rep]) - n[rep]
            lost = np.bitwise_or.reduceat(np.where(w_low < low[w_run], step, U(0)), first)
            per_run = np.zeros(int(run.max()) + 1, U)
            per_run[run[rep]] = lost
            bits |= per_run[run]
        out[own] = bits
    return out


def _block(table: pa.Table):
    buf, offsets = buffer_of(as_large(table.column("text")))
    return int(table.column("block")[0].as_py()), buf, offsets, table.column("doc_id").fill_null(_NULL_ID).to_numpy()


def _anchors(runs: Runs):
    """(order by anchor and run, whether a new anchor, whether a new run begins there)."""
    order = np.lexsort((runs.whole, runs.anchor))
    a, w = runs.anchor[order], runs.whole[order]
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    return order, new, new | np.r_[True, w[1:] != w[:-1]] if len(a) else new


def _equal_spans(buf: np.ndarray, hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Labels of equal spans, told apart by hash and then by bytes: one that chance gave its hash stands alone."""
    order, first, _ = groups(hashes)
    label = np.empty(len(order), np.int64)
    label[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    rep = order[first][label] if len(order) else order
    other = np.flatnonzero(rep != np.arange(len(order)))
    same = size[other] == size[rep[other]]
    for a in range(0, len(other), 50_000):
        part = other[a : a + 50_000]
        n = np.minimum(size[part], size[rep[part]])
        x = buf[_spread(at[part], n)] == buf[_spread(at[rep[part]], n)]
        same[a : a + 50_000] &= np.logical_and.reduceat(x, np.cumsum(n) - n) if len(n) else True
    stray = other[~same]
    label[stray] = len(first) + np.arange(len(stray))
    return label


def _survivors(table, answers, n_buckets, width):
    """What is left of a block after the sieve: runs to order whole, and windows of crowded anchors."""
    block, buf, offsets, ids = _block(table)
    runs = Runs(buf, offsets, width)
    order, first, keys = groups(runs.anchor)
    here = np.zeros(0, bool)
    if len(keys):
        docs = runs.doc[order]
        here = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    short = groups(keys & _MASK)[2]
    said = read_bits(answers, _SIEVE, n_buckets, short, np.uint8)[np.searchsorted(short, keys & _MASK)] if len(keys) else np.zeros(0, np.uint8)
    fate = np.empty(len(order), np.uint8)
    fate[order] = np.repeat(np.where(said > 0, said, here.astype(np.uint8)), np.diff(np.r_[first, len(order)]))
    sides = []
    for crowded in (False, True):
        at = np.flatnonzero(fate == 2 if crowded else fate == 1)
        start, length, doc, hashes, key = runs.at[at], runs.length[at], runs.doc[at], runs.whole[at], runs.anchor[at] & _MASK
        if crowded:
            doc, start = np.repeat(doc, length), _spread(start, length)
            length = np.ones(len(doc), np.int64)
            hashes = np.concatenate([Hasher(buf[a : a + 2 * SLICE_BYTES + width]).windows(width)[start[i:j] - a] for a, i, j in _stretches(start)] or [np.zeros(0, U)])
            key = hashes
        label = _equal_spans(buf, hashes, start, length + width - 1)
        low = _least(label, ids[doc])
        _, lead, label = np.unique(label, return_index=True, return_inverse=True)
        sides.append({"start": start, "length": length, "doc": doc, "low": low, "lead": lead, "label": label, "key": key[lead]})
    return block, buf, offsets, ids, sides


def _stretches(start: np.ndarray):
    """(place, first, last) of ascending starts that lie close together."""
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + 2 * SLICE_BYTES))
        yield int(start[i]), i, j
        i = j


def _cut(docs: DataFrame, width: int, answer, schema: StructType) -> tuple[DataFrame, Workspace]:
    """Rows that ``answer(table, buf, offsets, removed)`` gives for each block of (doc_id, text and more)."""
    ws = Workspace(docs.sparkSession)
    blocks = Blocks(docs, ws)
    n = blocks.n_buckets

    def sieve(table, _):
        block, buf, offsets, _ids = _block(table)
        runs = Runs(buf, offsets, width)
        order, new, new_run = _anchors(runs)
        keys = runs.anchor[order][new] & _MASK
        many = np.add.reduceat(new_run.astype(np.int64), np.flatnonzero(new)) if len(keys) else np.zeros(0, np.int64)
        order, first, short = groups(keys)
        many = np.minimum(np.add.reduceat(many[order], first), 255).astype(np.uint8) if len(keys) else many.astype(np.uint8)
        return as_table(send(block, _SIEVE, n, short, many, key_bytes=SHORT))

    def pass_sieve(_kind, order, first, vals):
        """0: one block has the anchor; 1: several do; 2: and in too many runs for a bucket."""
        size = np.diff(np.r_[first, len(order)])
        many = np.add.reduceat(vals[order].astype(np.int64), first)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(np.where(size < 2, 0, np.where(many > CROWD, 2, 1)), size)
        return out

    def survivors(table, said):
        block, buf, _, _, sides = _survivors(table, said, n, width)
        rows = []
        for kind, x in zip((_WHOLE, _SINGLE), sides, strict=True):
            order, cuts = dealt_out(bucket_of(x["key"], n), n)
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
                own = order[cuts[i] : cuts[i + 1]]
                lead = x["lead"][own]
                n_windows = x["length"][lead]
                raw = buf[_spread(x["start"][lead], n_windows + width - 1)].tobytes()
                vals = n_windows.astype(np.uint8).tobytes() + x["low"][lead].tobytes() + raw
                rows.append((block, int(i), kind, pack_keys(x["key"][own], SHORT if kind == _WHOLE else 8), vals))
        return as_table(rows)

    def order_suffixes(table):
        rows = []
        kinds = np.asarray(table.column("kind").to_numpy())
        for kind in np.unique(kinds):
            own = np.flatnonzero(kinds == kind)
            keys = [unpack_keys(table.column("keys")[int(i)].as_py(), SHORT if kind == _WHOLE else 8) for i in own]
            raw = [np.frombuffer(table.column("vals")[int(i)].as_py(), np.uint8) for i in own]
            size = [len(k) for k in keys]
            n_windows = np.concatenate([x[:k] for x, k in zip(raw, size, strict=True)]).astype(np.int64)
            ids = np.concatenate([x[k : 9 * k].view(np.int64) if not k % 8 else np.frombuffer(x[k : 9 * k].tobytes(), np.int64) for x, k in zip(raw, size, strict=True)])
            key = np.concatenate(keys)
            # a window's own hash is as good as an anchor: equal windows have it in common
            bits = gone_windows(key if kind == _WHOLE else key >> U(6), n_windows, ids, np.concatenate([x[9 * k :] for x, k in zip(raw, size, strict=True)]), width)
            for i, a, b in zip(own, np.cumsum(size) - size, np.cumsum(size), strict=True):
                rows.append((table.column("block")[int(i)].as_py(), table.column("bucket")[int(i)].as_py(), int(kind), bits[a:b].tobytes()))
        return as_table(rows, ["block", "bucket", "kind", "bits"])

    def last(table, said):
        _, buf, offsets, ids, sides = _survivors(table, said, n, width)
        edge = np.zeros(len(buf) + 1, np.int32)
        for kind, x in zip((_WHOLE, _SINGLE), sides, strict=True):
            bits = read_bits(said, kind, n, x["key"], np.uint32)[x["label"]]
            bits = np.where(ids[x["doc"]] > x["low"], np.uint32(0xFFFFFFFF), bits)
            some = np.flatnonzero(bits)
            at = _spread(x["start"][some], x["length"][some])
            step = _spread(np.zeros(len(some), np.int64), x["length"][some])
            at = at[(np.repeat(bits[some], x["length"][some]) >> step.astype(np.uint32)) & np.uint32(1) == 1]
            edge += np.bincount(at, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(at + width, minlength=len(edge)).astype(np.int32)
        return answer(table, buf, offsets, np.cumsum(edge[:-1]) > 0)

    first = blocks.ask(sieve, lambda t: judge_bits(t, pass_sieve, {_SIEVE: SHORT}, {_SIEVE: np.uint8}))
    sent = blocks.map(survivors, SENT, first)
    both = first.unionByName(ws.save(sent.groupBy("bucket").applyInArrow(order_suffixes, ANSWER)))
    del sent
    ws.release()
    return blocks.map(last, schema, both), ws


def removed_spans(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text after taking out strings of ``width`` bytes that a smaller id also has.

    Returns a row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Texts are
    UTF-8 bytes, null texts empty; windows overlap and never cross rows. Of equal ids none is
    smaller, so rows that repeat an id keep what only they share; a null id counts as larger
    than any. An empty table gives an empty result; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def digests(table, buf, offsets, gone):
        cols = [[], [], [], []]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            g, data = gone[a:b], buf[a:b]
            kept = data[~g] if g.any() else data
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + bool(len(g) and g[0]))
            for c, x in zip(cols, (b - a, int(g.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                c.append(x)
        arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())]
        return pa.table([table.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    long = [StructField(c, LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    out, ws = _cut(narrow, width, digests, StructType([*long, StructField("kept_sha256", StringType())]))
    return ws.finish(out)


def dedup_documents(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_chars`` set to what remains.

    A character of which a byte goes, goes whole. A text that nothing remains of goes, with its
    row; one that was empty before stays. The rows' other columns travel with their texts.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("_row"))

    def texts(table, buf, offsets, gone):
        left = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            g, data = gone[a:b], buf[a:b]
            if g.any():
                char = np.cumsum((data & 0xC0) != 0x80)
                lost = np.zeros(int(char[-1]) + 1, bool)
                lost[char[g]] = True
                data = data[~lost[char]]
            left.append(data.tobytes())
        kept = pa.array(left, pa.binary()).cast(pa.string())
        total = np.add.reduceat(np.r_[gone, False].astype(np.int64), offsets[:-1]) if len(gone) else np.zeros(len(left), np.int64)
        total = np.where(np.diff(offsets) > 0, total, 0)
        return pa.table([table.column("_row"), table.column("text").is_null(), kept, pa.array(total)], names=["_row", "_no_text", "_text", "_removed"])

    kinds = [rows.schema["_row"], StructField("_no_text", BooleanType()), StructField("_text", StringType()), StructField("_removed", LongType())]
    out, ws = _cut(rows, width, texts, relaxed(kinds))
    out = out.where((F.col("_text") != "") | (F.col("_removed") == 0))
    new = {"text": F.when(~F.col("_no_text"), F.col("_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_removed") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return ws.finish(out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]))
