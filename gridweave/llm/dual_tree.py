"""Hard-negative mining by a dual-tree search for inner products.

Anchors and candidates each lie in a tree: rows are ordered by a splitting tree learnt on a
bounded sample, cut into leaves of a fixed size, and leaves that follow one another share a
parent. A node knows a ball around its rows, so the inner products between two nodes lie in
an interval. Pairs of nodes are followed down from the roots as a table, a join a level; a pair whose
interval can't meet what any of its anchors still asks for goes with all that lies under it.
The pairs of leaves that remain are scored exactly, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.ordering import ordinal
from gridweave.workspace import Workspace

#: Rows that the splitting tree is learnt on, about.
SAMPLE = 8192
#: Rows of a leaf of anchors and of candidates; children of a node; leaves of anchors scored in one call.
ANCHOR_LEAF, CANDIDATE_LEAF, FANOUT, TOGETHER = 64, 512, 8, 32
#: Children that the first descent, which only finds bounds, follows.
BEAM = 3
#: Squared norms below this keep inner products exact in doubles.
MOST_SQUARED = 1 << 52
INF = float("inf")


def split_tree(x: np.ndarray, least: int = 16, deepest: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(directions, cuts) of a perfect binary tree: each node splits its rows at the median between two far ones."""
    depth = max(0, min(deepest, int(np.log2(max(1, len(x) / least)))))
    n = (1 << depth) - 1
    way, cut = np.zeros((n, x.shape[1])), np.zeros(n)
    held = {0: np.arange(len(x))}
    for node in range(n):
        at = held.pop(node)
        if not len(at):
            held |= {2 * node + 1: at, 2 * node + 2: at}
            continue
        own = x[at]
        far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        way[node] = far - own[((own - far) ** 2).sum(1).argmax()]
        along = own @ way[node]
        cut[node] = np.median(along)
        held |= {2 * node + 1: at[along <= cut[node]], 2 * node + 2: at[along > cut[node]]}
    return way, cut


def leaf_of(x: np.ndarray, way: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, place along the last split) of rows."""
    node, along = np.zeros(len(x), np.int64), np.zeros(len(x))
    for _ in range(len(cut).bit_length()):
        along = np.einsum("ij,ij->i", x, way[node])
        node = 2 * node + 1 + (along > cut[node])
    return node - len(cut), along


def _whole(vectors: DataFrame, is_anchor: Column, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(vec_id, label, anchor, dim, whole): the rows that take part, as packed integers."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    rows = rows.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))

    def run(batches):
        for b in batches:
            n = np.diff(b.column(3).offsets.to_numpy())
            flat = np.floor(256 * np.asarray(b.column(3).flatten(), np.float64))
            norm = np.add.reduceat(np.r_[flat * flat, 0.0], np.minimum(np.cumsum(n) - n, len(flat))) * (n > 0) if len(n) else n
            if (norm >= MOST_SQUARED).any():
                raise OverflowError("a vector is too long for exact inner products")
            ends = np.cumsum(n)
            whole = [flat[e - k : e].astype(np.int32).tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(whole, pa.binary())], ["vec_id", "label", "anchor", "dim", "whole"])

    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, dim int, whole binary")


def _ordered(rows: DataFrame, trees: dict, ws: Workspace, leaf_rows: int) -> DataFrame:
    """Rows with ``leaf``: their number in the tree's order, over the rows of a leaf."""

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            leaf, along = np.zeros(len(b), np.int64), np.zeros(len(b))
            whole = b.column(2)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in trees:
                    x = np.frombuffer(b"".join(whole.take(pa.array(at)).to_pylist()), np.int32).reshape(len(at), d).astype(np.float64)
                    leaf[at], along[at] = leaf_of(x, *trees[d])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf), pa.array(along)], ["uid", "part", "along"])

    placed = rows.join(rows.select("uid", "dim", "whole").mapInArrow(run, "uid long, part long, along double"), "uid")
    return ordinal(placed, [F.col(c) for c in ("dim", "part", "along", "uid")], ws, "n").withColumn("leaf", F.floor(F.col("n") / leaf_rows).cast("long")).drop("n", "part", "along")


_NODE = "dim int, node long, n long, center array<double>, radius double, norm double, low long, high long"


def _leaves(rows: DataFrame) -> DataFrame:
    """A row a leaf: its rows packed, by ascending id, and its node."""

    def pack(table: pa.Table) -> pa.Table:
        ids, uids = table.column("vec_id").to_numpy(), table.column("uid").to_numpy()
        order = np.lexsort((uids, ids))
        d = table.column("dim")[0].as_py()
        x = np.frombuffer(b"".join(table.column("whole").to_pylist()), np.int32).reshape(len(ids), d)[order]
        labels = table.column("label").to_numpy()[order]
        center = x.mean(0) if d else np.zeros(0)
        radius = float(np.sqrt(((x - center) ** 2).sum(1).max())) if d else 0.0
        row = {"dim": d, "node": table.column("leaf")[0].as_py(), "n": len(ids), "center": center.tolist(), "radius": radius, "norm": float(np.sqrt((center**2).sum())), "low": int(labels.min()), "high": int(labels.max())}
        row |= {"uids": uids[order].tobytes(), "ids": ids[order].tobytes(), "labels": labels.tobytes(), "wholes": x.tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64()), ("low", pa.int64()), ("high", pa.int64()), *[(c, pa.binary()) for c in ("uids", "ids", "labels", "wholes")]]))

    return rows.select("dim", "leaf", "uid", "vec_id", "label", "whole").groupBy("dim", "leaf").applyInArrow(pack, f"{_NODE}, uids binary, ids binary, labels binary, wholes binary")


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: a ball around the balls of at most FANOUT children."""

    def join(table: pa.Table) -> pa.Table:
        n, radius = table.column("n").to_numpy(), table.column("radius").to_numpy()
        centers = np.array(table.column("center").to_pylist(), np.float64).reshape(len(n), -1)
        center = (centers * n[:, None]).sum(0) / n.sum()
        far = float((np.sqrt(((centers - center) ** 2).sum(1)) + radius).max())
        row = {"dim": table.column("dim")[0].as_py(), "node": table.column("node")[0].as_py() // FANOUT, "n": int(n.sum()), "center": center.tolist(), "radius": far, "norm": float(np.sqrt((center**2).sum())), "low": min(table.column("low").to_pylist()), "high": max(table.column("high").to_pylist())}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64()), ("low", pa.int64()), ("high", pa.int64())]))

    up = nodes.select("dim", "node", "n", "center", "radius", "norm", "low", "high").withColumn("up", F.floor(F.col("node") / FANOUT).cast("long"))
    return up.groupBy("dim", "up").applyInArrow(join, _NODE)


def _levels(leaves: DataFrame, height: int, ws: Workspace) -> list[DataFrame]:
    levels = [leaves.select("dim", "node", "n", "center", "radius", "norm", "low", "high")]
    for _ in range(height):
        levels.append(ws.save(_parents(levels[-1])))
    return levels


def _asked(levels: list[DataFrame], windows: DataFrame) -> list[DataFrame]:
    """Levels of anchors with ``need`` and ``most``: the least and largest score that any anchor under a node asks for."""
    out = []
    for h, nodes in enumerate(levels):
        own = windows.groupBy("dim", F.floor(F.col("leaf") / FANOUT**h).cast("long").alias("node")).agg(F.min("need").alias("need"), F.max("most").alias("most"))
        out.append(nodes.join(own, ["dim", "node"]))
    return out


def _descend(anchors: list[DataFrame], candidates: list[DataFrame], same: bool, ws: Workspace, beam: int | None = None) -> DataFrame:
    """(dim, a, c): pairs of leaves whose interval of inner products may hold what an anchor asks for.

    ``same``: whether labels must agree, or differ. With ``beam``, only so many nodes of candidates are
    followed for each node of anchors, the likeliest first.
    """
    side = lambda nodes, s: nodes.select("dim", F.col("node").alias(s), F.floor(F.col("node") / FANOUT).cast("long").alias(f"{s}_up"), *[F.col(c).alias(f"{s}_{c}") for c in nodes.columns if c in ("center", "radius", "norm", "low", "high", "need", "most")])
    reach = F.col("a_radius") * F.col("c_norm") + F.col("c_radius") * F.col("a_norm") + F.col("a_radius") * F.col("c_radius")
    slack = (F.col("a_norm") + F.col("a_radius")) * (F.col("c_norm") + F.col("c_radius")) * 1e-9 + 1e-3
    keep = (F.col("dot") + reach + slack >= F.col("a_need")) & (F.col("dot") - reach - slack <= F.col("a_most"))
    pure = (F.col("a_low") == F.col("a_high")) & (F.col("c_low") == F.col("c_high")) & (F.col("a_low") == F.col("c_low"))
    keep &= (F.col("a_low") <= F.col("c_high")) & (F.col("c_low") <= F.col("a_high")) if same else ~pure
    dot = F.aggregate(F.zip_with("a_center", "c_center", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = None
    for h in range(len(anchors) - 1, -1, -1):
        a, c = side(anchors[h], "a"), side(candidates[h], "c")
        if pairs is None:
            met = a.join(c, "dim")  # one root a length of vectors
        else:
            up = pairs.withColumnsRenamed({"a": "a_up", "c": "c_up"})
            met = up.join(a, ["dim", "a_up"]).join(c, ["dim", "c_up"])
        met = met.withColumn("dot", dot).where(keep)
        if beam:
            likely = F.abs(F.least(F.col("a_most"), F.col("a_norm") * F.col("c_norm")) - F.col("dot"))
            met = met.withColumn("_k", F.row_number().over(Window.partitionBy("dim", "a").orderBy(likely, "c"))).where(F.col("_k") <= beam)
        before, pairs = pairs, ws.save(met.select("dim", "a", "c"))
        ws.drop(before)
    return pairs


def _scores(pairs: DataFrame, anchors: DataFrame, windows: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """(uid, slot, score, other_id, rank): each window's best ``k`` scores over the pairs of leaves, ties by id."""
    asks = windows.groupBy("dim", F.col("leaf").alias("a")).agg(F.collect_list(F.struct("uid", "slot", "need", "most")).alias("asks"))  # of the rows of a leaf
    a = anchors.select("dim", F.col("node").alias("a"), "uids", "ids", "labels", "wholes").join(asks, ["dim", "a"])
    c = candidates.select("dim", F.col("node").alias("c"), F.col("uids").alias("c_uids"), F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("wholes").alias("c_wholes"))
    pairs = pairs.withColumn("lot", F.floor(F.col("a") / TOGETHER).cast("long"))
    left = pairs.join(a, ["dim", "a"])
    right = pairs.select("dim", "c", "lot").distinct().join(c, ["dim", "c"])
    right = right.select(*[F.col(x).alias(f"r_{x}") for x in ("dim", "c", "lot")], "c_uids", "c_ids", "c_labels", "c_wholes")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if len(left) and len(right):
            d = right.column("r_dim")[0].as_py()
            take = lambda t, name, i=0, kind=np.int64: np.frombuffer(t.column(name)[i].as_py(), kind)
            uid, ids, labels = (take(right, f"c_{x}") for x in ("uids", "ids", "labels"))
            y = take(right, "c_wholes", 0, np.int32).reshape(len(ids), d).astype(np.float64)
            for i in range(len(left)):
                own, own_label = take(left, "uids", i), take(left, "labels", i)
                x = take(left, "wholes", i, np.int32).reshape(len(own), d).astype(np.float64)
                s = x @ y.T  # whole numbers below 2^52, so exact
                fit = (own_label[:, None] == labels[None]) & (own[:, None] != uid[None]) if same else own_label[:, None] != labels[None]
                asks = left.column("asks")[i].values
                who, slot, need, most = (np.asarray(asks.field(f)) for f in ("uid", "slot", "need", "most"))
                by = np.argsort(own)
                at = by[np.searchsorted(own, who, sorter=by)]
                hit = fit[at] & (s[at] >= need[:, None]) & (s[at] <= most[:, None])
                r, j = np.nonzero(hit)
                v = s[at[r], j]
                order = np.lexsort((uid[j], ids[j], -v, r))
                r, j, v = r[order], j[order], v[order]
                first = np.searchsorted(r, r)
                best = np.arange(len(r)) - first < k
                r, j, v = r[best], j[best], v[best]
                found.append([who[r], slot[r], v.astype(np.int64), ids[j], uid[j]])
        cat = lambda n, kind: pa.array(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64), kind)
        return pa.table([cat(0, pa.int64()), cat(1, pa.int32()), cat(2, pa.int64()), cat(3, pa.int64()), cat(4, pa.int64())], names=["uid", "slot", "score", "other_id", "other_uid"])

    hits = left.groupBy("dim", "c", "lot").cogroup(right.groupBy("r_dim", "r_c", "r_lot")).applyInArrow(score, "uid long, slot int, score long, other_id long, other_uid long")
    by = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "other_id", "other_uid")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("other_uid")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """The hardest negatives of each anchor and positive, by inner products of whole numbers.

    Components become floor(256 * x). The rows that ``is_anchor`` picks are anchors; an anchor's positives are
    the ``positives`` other rows of its label with the highest scores. For each, the ``negatives`` rows of other
    labels with the highest scores are found among those from ``low`` to ``high`` per cent of the
    positive's score. Ties go to the smaller id. Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; positives without a negative give no row.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
    different lengths are not compared. Rows that repeat an id are rows of their own. Of equal vectors of a
    label only the first ids, one more than can be asked for, can be among the best, so only these are
    candidates. An empty table, or one without anchors, gives an empty result; other columns are not
    read. A squared norm of 2^52 or more in whole numbers is an error.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark)
    rows = ws.save(_whole(vectors, is_anchor, id_col, label_col, vec_col).withColumn("uid", F.monotonically_increasing_id()))
    few = Window.partitionBy("dim", "label", "whole").orderBy("vec_id", "uid")
    others = ws.save(rows.withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= max(positives + 1, negatives)).drop("_k", "anchor"))
    own = rows.where("anchor").drop("anchor")
    n, n_anchors = others.count(), own.count()
    if not n_anchors:
        return ws.finish(rows.where("false").select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.lit(0).alias("rank"), F.col("vec_id").alias("negative_id"), F.col("label").alias("positive_score"), F.col("label").alias("negative_score")))
    sample = others.select("dim", "whole").sample(min(1.0, SAMPLE / n), 7).limit(2 * SAMPLE).collect()
    dims = {r.dim for r in sample if r.dim}
    trees = {d: split_tree(np.stack([np.frombuffer(r.whole, np.int32) for r in sample if r.dim == d]).astype(np.float64)) for d in dims}
    own, others = (ws.save(_ordered(x, trees, ws, size)) for x, size in ((own, ANCHOR_LEAF), (others, CANDIDATE_LEAF)))
    a_leaves, c_leaves = ws.save(_leaves(own)), ws.save(_leaves(others))
    height = 0
    while FANOUT**height < max(-(-n // CANDIDATE_LEAF), -(-n_anchors // ANCHOR_LEAF)):
        height += 1
    a_levels, c_levels = _levels(a_leaves, height, ws), _levels(c_leaves, height, ws)

    def search(windows: DataFrame, same: bool, k: int) -> DataFrame:
        """The best of each window. A narrow first descent finds scores that the best can't be under."""
        first = _descend(_asked(a_levels, windows), c_levels, same, ws, beam=BEAM)
        known = _scores(first, a_leaves, windows, c_leaves, same, k).where(F.col("rank") == k).select("uid", "slot", F.col("score").cast("double").alias("_known"))
        windows = windows.join(known, ["uid", "slot"], "left").withColumn("need", F.greatest("need", F.coalesce("_known", F.lit(-INF)))).drop("_known")
        windows = ws.save(windows)
        return ws.save(_scores(_descend(_asked(a_levels, windows), c_levels, same, ws), a_leaves, windows, c_leaves, same, k))

    asked = ws.save(own.select("dim", "leaf", "uid", F.lit(0).alias("slot"), F.lit(-INF).alias("need"), F.lit(INF).alias("most")))
    near = search(asked, True, positives).select("uid", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id"))
    p = F.col("positive_score")
    need = F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100")
    most = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
    windows = near.where(p >= 0).join(own.select("dim", "leaf", "uid"), "uid").select("dim", "leaf", "uid", "slot", need.cast("double").alias("need"), most.cast("double").alias("most"))
    far = search(ws.save(windows), False, negatives).select("uid", "slot", "rank", F.col("score").alias("negative_score"), F.col("other_id").alias("negative_id"))
    out = far.join(near, ["uid", "slot"]).join(own.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return ws.finish(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
