"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. A run splits all sets on sampled tokens: at
each node a set goes to the children of the tokens that a hash seeded by the node picks, two
on average, so sets that share most tokens share most children. A node is split only if that
makes fewer rows than its tiles have, so nodes of few sets and nodes whose sets share much aren't; their
pairs are looked at by brute force, first by sketches and then by whole sets. Runs repeat until a pair at the threshold is
missed less often than the target recall allows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm import tiles as tiling
from gridweave.llm.arrays import Hasher, U, give_back, mix, text_slices, word_spans
from gridweave.llm.tiles import deal, each_tile, gather, pairs_mask, roots
from gridweave.operators.components import components
from gridweave.workspace import Workspace

SHINGLE_WORDS = 5
#: Tokens of a sketch: the least by hash. Children of a node by set, on average.
SKETCH, BRANCH = 96, 2.0
RECALL = 0.9999
#: Nodes up to so many sets aren't split, nor are those on this depth.
SMALL, DEPTH = 256, 6
#: Sets that are compared to tell in how many children a node's pairs would meet again.
PROBES = 24
#: Nodes with more than this share of all rows are joined by broadcast; there are fewer of them than this.
HEAVY = 2000


def runs_for(threshold: float, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with the chance ``recall``, even if every node on its way is split to ``DEPTH``."""
    meets = 1.0
    for _ in range(DEPTH):  # a path goes on if one of the shared children's does
        meets = 1 - math.exp(-BRANCH * threshold * meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def splits(m: Column, again: Column) -> Column:
    """Whether splitting a node of ``m`` sets makes fewer rows, if its pairs meet in ``again`` children on average.

    By tiles it has a row a set and part, ``m`` times ``m`` over ``PART_ROWS``; split it has ``BRANCH`` rows a set, and
    ``again`` times those of its tiles.
    """
    return (m > SMALL) & (m * (1 - again) > BRANCH * tiling.PART_ROWS)


def join_sized(rows: DataFrame, sized: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined to ``sized``, which has a row a key with ``m``, its rows.

    Keys with more than a ``HEAVY``-th of all rows are fewer than ``HEAVY``, so they are broadcast; a task
    of the others' shuffle gets no more than that of one key.
    """
    heavy = F.col("m") > max(n_rows // HEAVY, 1)
    hot = F.broadcast(sized.where(heavy))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(sized.where(~heavy), key))


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, text index, words of each text), by text and then by shingle.

    A text with fewer words than a shingle has one, of all its words; one without words none.
    """
    s, e, t = word_spans(buf, offsets)
    h = Hasher(buf).spans(s, e)
    n_texts = len(offsets) - 1
    n = np.bincount(t, minlength=n_texts)
    first = np.cumsum(n) - n
    out = np.zeros(len(h), U)
    alive = np.ones(len(h), bool)
    place = np.arange(len(h)) - first[t] if len(h) else np.zeros(0, np.int64)
    width = np.minimum(n[t], SHINGLE_WORDS) if len(h) else place
    for k in range(SHINGLE_WORDS):
        use = width > k
        nxt = np.minimum(np.arange(len(h)) + k, len(h) - 1)
        out[use] = mix(out[use] * U(0x9E3779B97F4A7C15) + h[nxt[use]])
    alive = place + width <= n[t] if len(h) else alive
    out, t = out[alive], t[alive]
    order = np.lexsort((out, t))
    out, t = out[order], t[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (t[1:] != t[:-1])] if len(out) else np.zeros(0, bool)
    return out[new], t[new], n


def _picked(sketch: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Children of a node for a set: hashes of node and token, where the hash picks the token."""
    h = mix(mix(sketch ^ U(seed)) + U(0x2545F4914F6CDD1D))
    return h[(h >> U(11)).astype(np.float64) < BRANCH / max(len(sketch), 1) * 2.0**53]


def similar_documents(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Returns a row per input row: doc_id, copy_of (smallest id with the same set), n_links (other
    rows linked directly), class_id (smallest id reachable by links), kept. Sets that are equal
    are taken together before the join. Null and empty texts, texts without words, and rows
    with a null id link with nothing. Rows that repeat an id are documents of their own. An
    empty table gives an empty result; other columns are not read.
    """
    ws = Workspace(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _similar(narrow, ws, threshold)
    return ws.finish(out.select("doc_id", "copy_of", "n_links", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")))


def _similar(narrow: DataFrame, ws: Workspace, threshold: float) -> DataFrame:
    """A row per row of (doc_id, text): doc_id, text_key (of its text), copy_of, n_links, class_id, and whether its set leads its class."""

    def sketch(batches):
        for b in batches:
            size, sums, least = [], [], []
            for i, j, buf, offs in text_slices(b.column(1)):
                tok, t, _ = shingles(buf, offs)
                cut = np.searchsorted(t, np.arange(j - i + 1))
                both = mix(tok)
                for k in range(j - i):
                    own = both[cut[k] : cut[k + 1]]
                    size.append(len(own))
                    sums.append(own.sum().tobytes() + mix(own + U(1)).sum().tobytes() if len(own) else b"")
                    low = np.partition(own, SKETCH - 1)[:SKETCH] if len(own) > SKETCH else own
                    least.append(np.sort(low).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(sums, pa.binary()), pa.array(least, pa.binary())], ["doc_id", "text_key", "size", "digest", "sketch"])
        give_back()

    keyed = narrow.withColumn("text_key", text_key(F.col("text")))
    sets = ws.save(keyed.mapInArrow(sketch, "doc_id long, text_key string, size long, digest binary, sketch binary"))
    joinable = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    alike = sets.where(joinable).groupBy("size", "digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    alike = ws.save(alike.withColumn("id", F.xxhash64("size", "digest")))
    runs = runs_for(threshold)

    def start(batches):
        for b in batches:
            node, ids = [], []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, U)
                x = np.unique(np.concatenate([_picked(s, 0x5EED0000 + r) for r in range(runs)]))
                node.append(x)
                ids.append(np.full(len(x), k))
            cat = lambda z: np.concatenate(z) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cat(node).view(np.int64)), pa.array(cat(ids).astype(np.int64))], ["node", "id"])

    def descend(batches):
        for b in batches:
            node, ids = [], []
            for at, k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = _picked(np.frombuffer(raw, U), at & 0xFFFFFFFFFFFFFFFF)
                node.append(x)
                ids.append(np.full(len(x), k))
            cat = lambda z: np.concatenate(z) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cat(node).astype(U).view(np.int64)), pa.array(cat(ids).astype(np.int64))], ["node", "id"])

    def met_again(batches):
        for b in batches:
            out = []
            for group in b.column(1).to_pylist():
                s = [np.frombuffer(x, U) for x in group]
                _, of = np.unique(np.concatenate(s), return_inverse=True)
                a = np.zeros((len(s), of.max() + 1), np.float32)
                a[np.repeat(np.arange(len(s)), [len(x) for x in s]), of] = 1
                both = a @ a.T
                n = a.sum(1)
                j = both / np.maximum(n[:, None], n[None, :])  # a shared token leads both on where the longer set picks it
                out.append(BRANCH * float((j.sum() - len(s)) / max(len(s) * (len(s) - 1), 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["node", "again"])

    rows = alike.select("id", "sketch").mapInArrow(start, "node long, id long")
    leaves = None
    for depth in range(1, DEPTH + 1):
        rows = ws.save(rows)
        n_rows = rows.count()
        sizes = ws.save(rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        met = ws.save(join_sized(rows, sizes, "node", n_rows))
        ws.drop(rows)
        large = met.where(splits(F.col("m"), F.lit(0.0)))
        if depth == DEPTH or large.isEmpty():
            leaves = met if leaves is None else leaves.unionByName(met)
            break
        probe = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(PROBES))
        held = ws.save(large.drop("m").join(alike.select("id", "sketch"), "id"))
        probes = held.groupBy("node", probe.alias("_p")).agg(F.min(F.struct("id", "sketch")).alias("x"))
        probes = probes.groupBy("node").agg(F.collect_list("x.sketch").alias("sketches"))
        again = sizes.join(probes.mapInArrow(met_again, "node long, again double"), "node")
        told = ws.save(join_sized(held, ws.save(again), "node", n_rows))
        on = splits(F.col("m"), F.col("again"))
        ready = met.where(~splits(F.col("m"), F.lit(0.0))).unionByName(told.where(~on).select("node", "id", "m"))
        leaves = ready if leaves is None else leaves.unionByName(ready)
        rows = told.where(on).select("node", "id", "sketch").mapInArrow(descend, "node long, id long")
    leaves = ws.save(leaves.select("node", "id", "m"))
    paths = leaves.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    members = ws.save(alike.join(paths, "id").select("id", "doc", "size", "copies", "sketch", "nodes"))
    dealt = ws.save(deal(leaves))
    n_dealt = dealt.count()
    def candidates(table: pa.Table) -> pa.Table:
        """Rows of a tile that have a partner here, by sketch, that they meet nowhere before."""
        get = lambda c: table.column(c).to_numpy()
        node, lo, hi, ids, part, size = (get(c) for c in ("node", "lo", "hi", "id", "part", "size"))
        raw, nodes = table.column("sketch").to_pylist(), _lists(table.column("nodes"))
        keep = []
        for own in each_tile(node, lo, hi, ids):
            if len(own) < 2:
                continue
            both = _overlaps([np.frombuffer(raw[i], U) for i in own])
            ok = _likely(both, size[own].astype(np.float64), threshold) & pairs_mask(part[own], lo[own[0]], hi[own[0]])
            if ok.any():
                ok &= _overlaps([x[x < node[own[0]]] for x in (nodes(i) for i in own)]) == 0
                keep.append(own[ok.any(1)])
        at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        give_back()
        return table.select(["node", "lo", "hi", "part", "id", "doc", "size", "copies", "nodes"]).take(pa.array(at))

    kinds = "node long, lo int, hi int, part int, id long, doc long, size long, copies long, nodes array<long>"
    active = ws.save(gather(dealt, 4000, n_dealt).join(members, "id").groupBy("lot").applyInArrow(candidates, kinds))
    wanted = active.select(F.col("doc").alias("doc_id")).distinct()
    # as many as there are near copies: a share of all documents, so by shuffle at every size
    words = narrow.join(wanted.hint("shuffle_merge"), "doc_id", "left_semi").select("text")

    def whole(batches):
        for b in batches:
            out, digest, size = [], [], []
            for i, j, buf, offs in text_slices(b.column(0)):
                tok, t, _ = shingles(buf, offs)
                tok = mix(tok)
                cut = np.searchsorted(t, np.arange(j - i + 1))
                for k in range(j - i):
                    own = tok[cut[k] : cut[k + 1]]
                    digest.append(own.sum().tobytes() + mix(own + U(1)).sum().tobytes() if len(own) else b"")
                    out.append(own.tobytes())
                    size.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(out, pa.binary())], ["size", "digest", "tokens"])
        give_back()

    tokens = words.mapInArrow(whole, "size long, digest binary, tokens binary")
    tokens = tokens.groupBy(F.xxhash64("size", "digest").alias("id")).agg(F.first("tokens").alias("tokens"))
    tiles = gather(active, 2000, max(active.count(), 1)).join(tokens, "id")

    def verify(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        node, lo, hi, ids, part, size, copies = (get(c) for c in ("node", "lo", "hi", "id", "part", "size", "copies"))
        raw, nodes = table.column("tokens"), _lists(table.column("nodes"))
        found = [[], [], []]
        for own in each_tile(node, lo, hi, ids):
            if len(own) < 2:
                continue
            both = _overlaps([np.frombuffer(raw[int(i)].as_py(), U) for i in own])
            z = size[own].astype(np.float64)
            ok = (both >= threshold * (z[:, None] + z[None, :] - both) - 1e-6) & pairs_mask(part[own], lo[own[0]], hi[own[0]])
            if not ok.any():
                continue
            ok &= _overlaps([x[x < node[own[0]]] for x in (nodes(i) for i in own)]) == 0
            n_links = ok @ copies[own]
            at = np.flatnonzero(n_links)
            for f, x in zip(found, (ids[own][at], n_links[at], ids[own][roots(ok)[at]]), strict=True):
                f.append(x)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        give_back()
        return pa.table([cat(f) for f in found], names=["id", "n", "root"])

    links = ws.save(tiles.groupBy("lot").applyInArrow(verify, "id long, n long, root long"))
    group = ws.save(components(links, ws, "id", "root"))
    total = links.groupBy("id").agg(F.sum("n").alias("n"))
    told = ws.save(alike.select("size", "digest", "id", "doc", "copies").join(total, "id", "left").join(group, "id", "left").withColumn("component", F.coalesce("component", "id")))
    # a class is led by the set of its smallest id, or of several such by the set of the least digest
    lead = told.groupBy("component").agg(F.min(F.struct("doc", "size", "digest")).alias("first"))
    told = told.join(lead, "component")
    leads = (F.col("first.size") == F.col("size")) & (F.col("first.digest") == F.col("digest"))
    told = told.select(F.col("size").alias("_size"), F.col("digest").alias("_digest"), F.col("doc").alias("copy_of"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("first.doc").alias("class_id"), leads.alias("leads"))
    both = ["doc_id", "text_key", "size", "digest", "copy_of", "n_links", "class_id", "leads"]
    linked = sets.where(joinable).join(told, (sets["size"] == told["_size"]) & (sets["digest"] == told["_digest"])).select(*both)
    own = F.col("doc_id")
    alone = sets.where(~joinable).select("doc_id", "text_key", "size", "digest", own.alias("copy_of"), F.lit(0).cast("long").alias("n_links"), own.alias("class_id"), F.lit(True).alias("leads"))
    return linked.unionByName(alone)


def text_key(text):
    """Tells texts apart: its MD5, or a mark that sorts after any for null."""
    return F.coalesce(F.md5(text), F.lit("null"))


def _likely(both: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by the shared tokens of their sketches.

    Sets that fit a sketch are told exactly; of larger ones less than four and a half deviations
    of what a pair at the threshold shares is too little.
    """
    a, b = size[:, None], size[None, :]
    large = np.maximum(a, b)
    p = np.minimum(threshold / (1 + threshold) * (a + b) / large, 1)
    held = np.minimum(large, SKETCH)
    need = held * p - np.where(large > SKETCH, 4.5 * np.sqrt(held * p * (1 - p)), 1e-6)
    return (both >= need) & (np.minimum(a, b) >= threshold * large - 1e-6)


def _lists(column):
    """A function from row number to the array of a list column."""
    c = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    offsets, values = c.offsets.to_numpy(), c.values.to_numpy()
    return lambda i: values[offsets[i] : offsets[i + 1]]


def _overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by stretches of the tokens that two sets or more hold."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    tok = np.concatenate(sets)
    order = np.argsort(tok, kind="stable")
    s, r = tok[order], row[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(s)])
    shared = np.repeat(size > 1, size)
    r = r[shared]
    col = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, chunk):
        i, j = np.searchsorted(col, (a, a + chunk))
        m = np.zeros((n, min(chunk, int(col[-1]) + 1 - a)), np.float32)
        m[r[i:j], col[i:j] - a] = 1
        out += m @ m.T
    return out


def similar_groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the first by id, then by its shingles' digest.

    Rows that share an id but not their texts are documents of their own. Of rows equal in id and
    shingles, or both without words, the one with the least text key stays, and of rows with one text the
    first by all columns as JSON. Rows with a null id all stay.
    """
    ws = Workspace(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _similar(narrow, ws, threshold).where("leads and doc_id = class_id")
    each = found.groupBy("doc_id", "size", "digest", "text_key").agg(F.count(F.lit(1)).alias("times"))
    one = each.groupBy("doc_id", "size", "digest").agg(F.min(F.struct("text_key", "times")).alias("x"))
    one = ws.finish(one.select(F.col("doc_id").alias("_id"), F.col("x.text_key").alias("_key"), F.col("x.times").alias("_times")))

    def kept(which: DataFrame) -> DataFrame:
        same = (docs["doc_id"].cast("long") == which["_id"]) & (text_key(docs["text"]) == which["_key"])
        return docs.join(which, same)

    out = kept(one.where("_times = 1")).select(*[docs[c] for c in docs.columns]).unionByName(docs.where("doc_id is null"))
    again = one.where("_times > 1")
    if not again.isEmpty():
        row = F.struct(*[docs[c] for c in docs.columns])
        first = kept(again).select(row.alias("_row"), again["_id"], again["_key"])
        first = first.groupBy("_id", "_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        out = out.unionByName(first.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
    return out
