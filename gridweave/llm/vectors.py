"""Embedding near-dedup: sign hashing by random hyperplanes, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.tiles import deal, each_tile, gather, pairs_mask, roots
from gridweave.operators.components import components
from gridweave.workspace import Workspace

#: Chance at least that a pair just at the threshold meets in a table.
RECALL = 0.9999
SEED = 11


def tables_for(threshold: float, bits: int, recall: float = RECALL) -> int:
    """Hash tables of so many bits in which a pair at the threshold meets with the chance ``recall``."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.RandomState(SEED).standard_normal((dim, bits * tables))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links of vectors with a cosine of ``threshold`` or more, in double precision.

    Returns a row per input row: vec_id, n_links (other rows linked directly), component_id
    (smallest id reachable), kept. Equal vectors are taken together first; the others meet in
    buckets of sign hashes whose number of bits grows with the table, and a pair counts in the
    first table where it meets. Null, empty and zero vectors, those with null or non-finite
    components, and rows with a null id link with nothing; vectors of different lengths don't
    link. Rows that repeat an id are vectors of their own. An empty table gives an empty
    result; other columns are not read.
    """
    ws = Workspace(vectors.sparkSession)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", ok)
    good = rows.where("ok").select("vec_id", "v")
    alike = good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    alike = ws.save(alike)
    n = alike.count()
    bits = max(8, min(24, math.ceil(math.log2(max(n, 1) / 64 + 1))))
    tables = tables_for(threshold, bits)

    def sign(batches):
        cache = {}
        for b in batches:
            out = []
            for row, k, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append((len(row), np.array(row, np.float64), k, copies))
            ids, vecs, codes, many = [], [], [], []
            for d in sorted({x[0] for x in out}):
                own = [x for x in out if x[0] == d]
                x = np.stack([y[1] for y in own])
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                if d not in cache:
                    cache[d] = planes(d, bits, tables)
                side = (x @ cache[d] > 0).reshape(len(x), tables, bits)
                code = (side @ (1 << np.arange(bits))).astype(np.int32)
                ids += [y[2] for y in own]
                many += [y[3] for y in own]
                vecs += [y.tobytes() for y in x]
                codes += [y.tobytes() for y in code]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(many, pa.int64()), pa.array(vecs, pa.binary()), pa.array(codes, pa.binary())], ["id", "copies", "vec", "codes"])

    signed = ws.save(alike.select("v", "id", "copies").mapInArrow(sign, "id long, copies long, vec binary, codes binary"))
    node = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("codes"), t * 4 + 1, F.lit(4))))
    spread = signed.select("id", node.alias("t", "code"), F.length("vec").alias("size")).select("id", "t", F.xxhash64("t", "code", "size").alias("node"))
    met = spread.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = ws.save(deal(spread.join(met, "node")))
    tiles = gather(met, 8000, met.count()).join(signed, "id")

    def compare(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        ids, copies, t, part = get("id"), get("copies"), get("t"), get("part")
        lo, hi = get("lo"), get("hi")
        vec, codes = table.column("vec").to_pylist(), table.column("codes").to_pylist()
        found_id, found_n, found_root = [], [], []
        for own in each_tile(get("node"), lo, hi, ids):
            if len(own) < 2:
                continue
            x = np.stack([np.frombuffer(vec[i], np.float64) for i in own])
            linked = (x @ x.T >= threshold) & pairs_mask(part[own], lo[own[0]], hi[own[0]])
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            c = np.stack([np.frombuffer(codes[i], np.int32) for i in own])
            for s in range(0, len(a), 100_000):
                p, q = a[s : s + 100_000], b[s : s + 100_000]
                first = (c[p] == c[q]).argmax(1) == t[own[0]]
                linked[p[~first], q[~first]] = False
            n_links = linked @ copies[own]
            at = np.flatnonzero(n_links)
            found_id.append(ids[own][at])
            found_n.append(n_links[at])
            found_root.append(ids[own][roots(linked)[at]])
        cat = lambda z: pa.array(np.concatenate(z) if z else np.zeros(0, np.int64), pa.int64())
        return pa.table([cat(found_id), cat(found_n), cat(found_root)], names=["id", "n", "root"])

    links = ws.save(tiles.groupBy("lot").applyInArrow(compare, "id long, n long, root long"))
    group = components(links, ws, "id", "root").select("id", "component")
    total = links.groupBy("id").agg(F.sum("n").alias("n"))
    alike = alike.join(total, "id", "left").join(group, "id", "left")
    alike = alike.select(F.col("v").alias("_v"), "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component_id"))
    linked = good.join(alike, good["v"] == alike["_v"]).select("vec_id", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return ws.finish(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
