"""Questions about keys of a whole corpus, asked by blocks of documents.

Documents lie in blocks of bounded size. In a round every block sends its distinct
keys, packed by bucket into one row a bucket; each bucket then sees all blocks' claims
on its keys and packs an answer for each block, in the order of the keys that
block sent. Keys are distinct within a block, so a key that a third of all documents
share reaches its bucket once a block, and no task ever holds more than a block or a
bucket. Spark deals out and recovers both; numpy works inside.

Blocks and buckets both grow with the corpus up to a bound, so a round has a row for
each block and bucket, but never more rows than keys.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from gridweave.llm.arrays import U, give_back, mix
from gridweave.workspace import Workspace

#: Least and greatest text bytes of a block, and greatest text bytes whose keys a bucket gets; between
#: them blocks and buckets grow with the corpus.
BLOCK_BYTES, BUCKET_BYTES = (4 << 20, 64 << 20), 256 << 20
#: Blocks of one part of the table at most: Spark allows 100,000 buckets; more blocks make more parts.
TABLE_BLOCKS = 50_000
#: Equal rows of more than half so many are dealt to several blocks, however short they are.
BLOCK_ROWS = 200_000
SENT = "block int, bucket int, kind int, keys binary, vals binary"
ANSWER = "block int, bucket int, kind int, bits binary"
_SENT_NAMES = ["block", "bucket", "kind", "keys", "vals"]


class Blocks:
    """Documents (doc_id, text and more) in a table bucketed by block, so that rounds don't shuffle texts again.

    A row's block follows from its id and text, so rows that repeat an id or lack one spread out;
    rows equal in both that would fill a block are dealt to all blocks. The table lies in the workspace.
    ``prepare`` may turn each block's rows to rows of ``schema`` (with a block column) that are
    written in their stead.
    """

    def __init__(self, docs: DataFrame, ws: Workspace, prepare: Callable | None = None, schema: StructType | None = None):
        self.ws, self.spark = ws, docs.sparkSession
        # rows equal in id and text are counted before anything is dealt out
        own = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        alike = docs.groupBy(F.xxhash64("doc_id", "text", F.lit(7)).alias("_hash")).agg(F.sum(own).alias("_bytes"), F.count(F.lit(1)).alias("_times"))
        alike = ws.save(alike)
        total = alike.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
        self.bytes = total
        size = min(max(BLOCK_BYTES[0], total // 20_000), BLOCK_BYTES[1])
        self.n = max(1, -(-total // size))
        self.n_buckets = max(1, -(-total // min(max(BLOCK_BYTES[0], total // 20_000), BUCKET_BYTES)))
        block = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(self.n)).cast("int").alias("block")
        many = self._spread(docs, alike, size)
        m = min(self.n, TABLE_BLOCKS)
        dealt = docs.select(block, "*") if many is None else many
        dealt = dealt.repartition(m, "block")
        if prepare is not None:
            dealt = dealt.groupBy("block").applyInArrow(prepare, schema)
        part = F.floor(F.col("block") / TABLE_BLOCKS).cast("int").alias("_part")
        self.name = f"blocks_{uuid.uuid4().hex}"
        dealt.select(part, "*").write.format("parquet").option("compression", "zstd").partitionBy("_part").bucketBy(m, "block").option("path", ws.own_table(self.name)).saveAsTable(self.name)
        ws.drop(alike)
        self.parts = -(-self.n // TABLE_BLOCKS)

    def _spread(self, docs: DataFrame, alike: DataFrame, size: int) -> DataFrame | None:
        """``docs`` with blocks in which equal rows of more than half a block's bytes or rows lie apart; None if there are none.

        Such rows are saved, and dealt by their places in the saved files, which a task that runs
        again finds unchanged. Their hashes are at most two a block's worth of bytes or rows.
        """
        heavy = alike.where((F.col("_times") > 1) & ((F.col("_bytes") > size // 2) | (F.col("_times") > BLOCK_ROWS // 2))).select("_hash")
        n = heavy.count()
        if n == 0:
            return None
        if n <= 1_000_000:
            heavy = F.broadcast(heavy)
        hashed = docs.withColumn("_hash", F.xxhash64("doc_id", "text", F.lit(7)))
        block = F.pmod(F.col("_hash"), F.lit(self.n)).cast("int").alias("block")
        apart = self.ws.save(hashed.join(heavy, "_hash", "left_semi").select(*docs.columns))
        anywhere = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(self.n)).cast("int").alias("block")
        rest = hashed.join(heavy, "_hash", "left_anti").select(block, *docs.columns)
        return rest.unionByName(apart.select(anywhere, "*"))

    def _each_part(self):
        """(rows of a part, condition of its blocks)."""
        table = self.spark.table(self.name)
        for k in range(self.parts):
            yield table.where(F.col("_part") == k).drop("_part"), F.col("block").between(k * TABLE_BLOCKS, (k + 1) * TABLE_BLOCKS - 1)

    def map(self, fn: Callable, schema: str | StructType, answers: DataFrame | None = None) -> DataFrame:
        """Apply ``fn(texts, answers)`` to each block; answers is None without such a table."""

        def apply(texts: pa.Table, said: pa.Table | None) -> pa.Table:
            result = fn(texts, said)
            give_back()
            return result

        out = []
        for table, own in self._each_part():
            if answers is None:
                out.append(table.groupBy("block").applyInArrow(lambda t: apply(t, None), schema))
            else:
                out.append(table.groupBy("block").cogroup(answers.where(own).groupBy("block")).applyInArrow(lambda t, x: apply(t, x) if t.num_rows else none_of(schema), schema))
        return functools.reduce(DataFrame.unionByName, out)

    def ask(self, fn: Callable, judge: Callable, answers: DataFrame | None = None) -> DataFrame:
        """A round: blocks send by ``fn``, buckets answer by ``judge``; the saved answers."""
        sent = self.map(fn, SENT, answers)
        return self.ws.save(sent.groupBy("bucket").applyInArrow(judge, ANSWER))


def none_of(schema: str | StructType) -> pa.Table:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()


def relaxed(fields: list[StructField]) -> StructType:
    """A schema of these fields in which anything may be null, as tables give them back."""
    said = json.dumps(StructType(fields).jsonValue())
    for mark in ("nullable", "containsNull", "valueContainsNull"):
        said = said.replace(f'"{mark}": false', f'"{mark}": true')
    return StructType.fromJson(json.loads(said))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each group in that order, distinct keys ascending)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return order, first, s[first]


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys ^ U(0x5851F42D4C957F2D)) % U(n)).astype(np.int32)


def dealt_out(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, places in that order where each of ``n`` buckets begins, and the end)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def send(block: int, kind: int, n: int, keys: np.ndarray, vals: np.ndarray | None = None, key_bytes: int = 8) -> list[tuple]:
    """Rows for distinct ``keys``, one a bucket, each in ascending order of keys."""
    order, cuts = dealt_out(bucket_of(keys, n), n)
    rows = []
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
        at = order[cuts[i] : cuts[i + 1]]
        rows.append((block, int(i), kind, pack_keys(keys[at], key_bytes), b"" if vals is None else np.ascontiguousarray(vals[at]).tobytes()))
    return rows


def as_table(rows: list[tuple], names: list[str] = _SENT_NAMES) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 3)]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack_keys(keys: np.ndarray, key_bytes: int) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :key_bytes]).tobytes()


def unpack_keys(raw: bytes, key_bytes: int = 8) -> np.ndarray:
    if key_bytes == 8:
        return np.frombuffer(raw, U)
    a = np.frombuffer(raw, np.uint8).reshape(-1, key_bytes)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :key_bytes] = a
    return out.view(U).ravel()


def judge_bits(table: pa.Table, verdict: Callable, key_bytes: dict[int, int], val_type: dict[int, object]) -> pa.Table:
    """Answer every row with a bit per key.

    ``verdict(kind, order, first, vals)`` gets the claims on keys in groups and returns a
    boolean (packed to a bit) or a value of fixed size for each claim, in the order of the
    claims. ``val_type``: by kind, the dtype of vals.
    """
    rows = []
    kinds = np.asarray(table.column("kind").to_numpy())
    blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    keys_col, vals_col = table.column("keys"), table.column("vals")
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        parts = [unpack_keys(keys_col[int(i)].as_py(), key_bytes.get(int(kind), 8)) for i in own]
        vt = val_type.get(int(kind))
        vals = np.concatenate([np.frombuffer(vals_col[int(i)].as_py(), vt) for i in own]) if vt is not None else None
        order, first, _ = groups(np.concatenate(parts))
        said = verdict(int(kind), order, first, vals)
        at = 0
        for i, p in zip(own, parts, strict=True):
            x = said[at : at + len(p)]
            rows.append((blocks[i], buckets[i], int(kind), (np.packbits(x) if x.dtype == bool else x).tobytes()))
            at += len(p)
    return as_table(rows, ["block", "bucket", "kind", "bits"])


def read_bits(answers: pa.Table, kind: int, n: int, keys: np.ndarray, dtype=bool, bucket: np.ndarray | None = None) -> np.ndarray:
    """The answers of one kind, in the order of ``keys`` (as they were sent; ``bucket`` where it doesn't follow from them)."""
    order, cuts = dealt_out(bucket_of(keys, n) if bucket is None else bucket, n)
    out = np.zeros(len(order), dtype)
    for k, i, raw in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if k == kind:
            at = order[cuts[i] : cuts[i + 1]]
            out[at] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(at)).astype(bool) if dtype is bool else np.frombuffer(raw, dtype)
    return out
