"""Mixing sources to target weights by capped water-filling.

Sources share all words in proportion to their weights; a source is clamped at
``max_epochs`` times its own size and what it can't take is shared again among
the others until none is above its clamp. A document is then taken a whole
number of times plus, for a seeded part of its source, once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.ordering import ordinal
from gridweave.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded order that split a source, so that a hot one is many groups.
SPLIT_DIGITS = 3


def n_words(text):
    """Number of words of a text column; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, ws: Workspace, weights=(1, 2, 3), max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size) -> those, ``_rank``, ``weight`` and ``target``.

    Weights are dealt to the sources in code-point order, null last, in turn. Targets sum to
    the sum of the sizes when ``max_epochs`` is 1 or more; with less every source is clamped.
    Each round is one aggregate over the sources that brings two sums to the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ordinal(sizes, [F.col("source").asc_nulls_last()], ws, "_rank")
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ws.save(ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))))
    total, all_weight = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    rest, weight, clamped = total or 0.0, all_weight or 1.0, -1
    while True:
        above = F.col("weight") * F.lit(rest) / F.lit(weight) > F.col("_cap")
        cap, w, n = ranked.where(above).agg(F.coalesce(F.sum("_cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count(F.lit(1))).first()
        if n == clamped or n == 0:
            break
        clamped = n
        if w >= (all_weight or 1.0):
            return ranked.withColumn("target", F.col("_cap")).drop("_cap")
        rest, weight = total - cap, all_weight - w
    share = F.col("weight") * F.lit(rest) / F.lit(weight)
    return ranked.withColumn("target", F.when(share > F.col("_cap"), F.col("_cap")).otherwise(share)).drop("_cap")


def mix_plan(docs: DataFrame, weights=(1, 2, 3), max_epochs: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: the id, size, source_size, target, taken (words, repeats
    counted), repeats, weight. Null texts have size 0; null sources are one source. The extra
    fractional repetition goes to documents in md5 order of seed and id while the middle of a
    document lies inside what the source still owes, so a source misses its target by half a
    document at most. Rows that repeat an id are taken by the same order, ties by size. An
    empty table gives an empty result; other columns of the input are not read.
    """
    ws = Workspace(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    sized = ws.save(sized)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = ws.save(source_targets(sizes, ws, weights, max_epochs))
    hint = F.broadcast if targets.count() <= 100_000 else (lambda t: t)
    key = F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string")))
    rows = sized.alias("d").join(hint(targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", "size", "source_size", "target", "weight", "_rank", key.alias("_key"))
    rows = rows.withColumn("_part", F.substring("_key", 1, SPLIT_DIGITS))
    parts = rows.groupBy("_rank", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_rank", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_rank", "_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["_rank", "_part"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    owed = F.col("target") - whole * F.col("source_size")
    extra = (2 * (F.col("_before") + F.col("_ahead")) + F.col("size") <= 2 * owed) & (owed > 0) & (F.col("size") > 0)
    repeats = whole + F.when(extra, 1).otherwise(0)
    return ws.finish(rows.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"), "weight"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the plan takes its id.

    Ids are taken to be unique; of rows that repeat an id each gets the largest number of
    repeats that the plan has for it. Columns are those of the input.
    """
    plan = mix_plan(docs, **options).groupBy("doc_id").agg(F.max("repeats").alias("_repeats")).withColumnRenamed("doc_id", "_id")
    id_col = options.get("id_col", "doc_id")
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan["_id"])).where(plan["_repeats"] > 0)
    own = [docs[c] for c in docs.columns]
    return joined.select(*own, F.explode(F.sequence(F.lit(1), plan["_repeats"])).alias("_copy_number")).select(*own)
