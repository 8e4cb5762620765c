"""Entropy balancing of sources to target token weights. DataFrame functions only.

Each document has a rate: how many copies of it the mix takes. Among all rate vectors that meet the
token constraint of every source, entropy balancing picks the one closest to one copy each (relative
entropy weighted by document size). The dual of that problem has one multiplier per source and its
gradient needs the tilted token sums only, so each Newton step reads a partial aggregate, not rows.
Rates are exp(multiplier); they become whole copies by a hash threshold per source that is resolved
over two histogram levels. The rest of the error is closed over counts of documents by size: the longest that fit go
first, then the one move that overshoots least, until no move of one document by one copy brings a source closer.

Defined cases: null text has size 0; size 0 is never taken; null source is one source, last in order;
rows that repeat a doc_id share its hash, hence their copies, and move together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .common import WORD_RE, fresh, materialize

MAX_RATE = 3
NEWTON_STEPS = 64
BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: source_size, target. Capped targets reshare their excess by weight.

    The fixed point of the resharing is level filling: target = min(cap, level * weight). With sources
    in ascending order of cap / weight, the level follows from running sums of the capped part.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    fill = W.orderBy("ratio", F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_rate)).withColumn("ratio", F.col("cap") / F.col("weight"))
    below = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("ratio")
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(everything)["level_here"])
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    return s.select("source", "source_size", "target")


def newton_dual(size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """Multiplier of one constraint: root of size * exp(m) - target by Newton steps on the convex dual."""
    step = lambda m, _: m - (size * F.exp(m) - target) / (size * F.exp(m))
    return F.when((size > 0) & (target > 0), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.log(F.greatest(target / size, F.lit(1e-12))) * 0.5, step))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = MAX_RATE) -> DataFrame:
    """Every document with size, source_size, target, rate, copies and taken = size * copies."""
    unit = F.xxhash64("doc_id", F.lit(7))
    rows = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_RE)).cast("long").alias("size"))
    rows = rows.withColumn("b1", F.pmod(unit, F.lit(BINS)).cast("int")).withColumn("b2", F.pmod(F.shiftright(unit, 20), F.lit(BINS)).cast("int"))
    rows = materialize(rows, "mix-sizes")
    goals = source_targets(rows, weights, max_rate)
    goals = goals.withColumn("rate", F.coalesce(F.exp(newton_dual(F.col("source_size"), F.col("target"))), F.lit(0.0)))
    goals = goals.withColumn("base", F.least(F.floor(F.col("rate") + 1e-9), F.lit(max_rate)).cast("long"))
    goals = goals.withColumn("extra", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0)))
    goals = materialize(goals, "mix-goals")

    def crossing(cells: DataFrame, bin_name: str, need: str) -> DataFrame:
        """Per source: first bin whose running size passes the need, and what is needed inside it."""
        run = W.partitionBy("source").orderBy(bin_name).rowsBetween(W.unboundedPreceding, W.currentRow)
        cells = cells.withColumn("upto", F.sum("cell").over(run)).where(F.col("upto") > F.col(need))
        return cells.groupBy("source").agg(F.min(bin_name).alias(f"cut_{bin_name}"), F.min(F.struct(bin_name, (F.col(need) - F.col("upto") + F.col("cell")).alias("r")))["r"].alias(f"need_{bin_name}"))

    attach = lambda left, right: left.join(right.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    cells1 = attach(rows.groupBy("source", "b1").agg(F.sum("size").alias("cell")), goals.select("source", "extra"))
    cut1 = crossing(cells1, "b1", "extra")
    inside = attach(rows, cut1).where(F.col("b1") == F.col("cut_b1"))
    cells2 = inside.groupBy("source", "b2", "need_b1").agg(F.sum("size").alias("cell"))
    cuts = materialize(attach(attach(goals, cut1), crossing(cells2, "b2", "need_b1")), "mix-cuts")
    more = F.when(F.col("cut_b1").isNull(), F.col("extra") > 0).otherwise((F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.coalesce("cut_b2", F.lit(0)))))
    taken = attach(rows, cuts).withColumn("copies", F.least(F.col("base") + more.cast("long"), F.lit(max_rate)))
    taken = materialize(taken.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0))).select("doc_id", "source", "size", "source_size", "target", "rate", "copies"), "mix-copies")
    return _repair(taken, max_rate)


def close_gap(gap: float, counts: dict[int, list[int]]) -> dict[int, list[int]]:
    """Counts after the moves. counts: by size, how many documents have 0, 1, ... copies; a gap above 0 asks for copies."""
    now = {size: list(n) for size, n in sorted(counts.items(), reverse=True)}

    def move(size: int, most: int) -> int:
        """Move up to most copies of documents of one size, first those that have the fewest (to remove: the most)."""
        n, left, up = now[size], most, gap > 0
        for c in range(len(n) - 1) if up else range(len(n) - 1, 0, -1):
            k = min(n[c], left)
            n[c], n[c + (1 if up else -1)], left = n[c] - k, n[c + (1 if up else -1)] + k, left - k
        return most - left

    while gap:
        for size in now:
            k = move(size, int(abs(gap) // size))
            gap -= k * size if gap > 0 else -k * size
        over = [size for size, n in now.items() if size < 2 * abs(gap) and sum(n[:-1] if gap > 0 else n[1:])]
        if not over:
            break
        move(min(over), 1)
        gap -= min(over) if gap > 0 else -min(over)
    return now


def _ranges(before: list[int], after: list[int]) -> list[tuple[int, int, int, int]]:
    """copies, new copies, and the first and last rank by hash of those that get them; order by copies is kept."""
    out, a, b = [], 0, 0
    was, will, rank = list(before), list(after), 0
    while a < len(was) and b < len(will):
        k = min(was[a], will[b])
        if k and a != b:
            out.append((a, b, rank + 1, rank + k))
        was[a], will[b], rank = was[a] - k, will[b] - k, rank + k
        if not was[a]:
            a, rank = a + 1, 0
        else:
            b += 1
    return out


def _repair(taken: DataFrame, max_rate: int) -> DataFrame:
    """Close what rounding left. The driver reads counts by size, of sizes under twice their source's gap."""
    cell = ["source", "size", "copies"]
    gap = taken.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    units = taken.where("size > 0").groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.max("copies").cast("int").alias("copies"))
    units = units.join(F.broadcast(gap.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("size") < 2 * F.abs("gap"))
    units = materialize(units.select(*cell, "doc_id", "gap", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(BINS)).cast("int").alias("bin")), "mix-units")
    found: dict = {}
    for r in units.groupBy(*cell).agg(F.max("gap").alias("gap"), F.count("*").alias("n")).collect():
        found.setdefault(r.source, (r.gap, {}))[1].setdefault(r["size"], [0] * (max_rate + 1))[r.copies] += r.n
    moves = []
    for source, (left, counts) in found.items():
        after = close_gap(left, counts)
        moves += [(source, size, *m) for size, n in counts.items() for m in _ranges(n, after[size])]
    spark = taken.sparkSession
    kind = taken.schema["source"].dataType.simpleString()
    plan = F.broadcast(spark.createDataFrame(moves, f"m_source {kind}, m_size long, m_copies int, new int, lo long, hi long"))
    same = F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size")) & (F.col("copies") == F.col("m_copies"))
    some = units.join(F.broadcast(plan.select("m_source", "m_size", "m_copies").distinct()), same, "left_semi")
    bins = some.groupBy(*cell, "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("below", F.sum("n").over(W.partitionBy(*cell).orderBy("bin")) - F.col("n"))
    ranked = some.withColumn("r", F.row_number().over(W.partitionBy(*cell, "bin").orderBy("doc_id")))
    bins = bins.select(*[F.col(c).alias(f"b_{c}") for c in (*cell, "bin")], "below")
    ranked = ranked.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("copies") == F.col("b_copies")) & (F.col("bin") == F.col("b_bin")))
    moved = ranked.withColumn("r", F.col("r") + F.col("below")).join(plan, same & F.col("r").between(F.col("lo"), F.col("hi")))
    moved = materialize(moved.select(F.col("source").alias("m_source"), F.col("doc_id").alias("m_doc"), "new"), "mix-moves")
    out = taken.join(moved, F.col("doc_id").eqNullSafe(F.col("m_doc")) & F.col("source").eqNullSafe(F.col("m_source")), "left")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.coalesce(F.col("new").cast("long"), "copies")).otherwise(F.col("copies")))
    return out.drop("m_source", "m_doc", "new").withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row, as often as its copies say; columns of any name pass through."""
    name, copies, nth = (fresh(docs, c) for c in ("mix_id", "mix_copies", "mix_nth"))
    plan = mix_sources(docs).groupBy(F.col("doc_id").alias(name)).agg(F.max("copies").cast("int").alias(copies))
    out = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(name))).where(F.col(copies) > 0)
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
