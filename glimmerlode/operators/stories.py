"""Sentences about functions, paths and samples, made of Columns from the enriched functions and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import columns as C, rules


def joined(items: Column, sep: str = ", ") -> Column:
    """The items that are neither null nor blank, joined."""
    return F.array_join(F.filter(items, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), sep)


def _holds(roles: Column, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(roles, F.array(*[F.lit(r) for r in wanted]))) == len(wanted)


def path_narrative(roles: Column, structures: Column) -> Column:
    """Up to two notes on a path by its roles, else one by its structure."""
    notes = C.compact(*[F.when(_holds(roles, wanted), note) for wanted, note in rules.PATH_NOTES])
    plain = F.when(F.array_contains(structures, "dispatcher"), rules.PATH_DISPATCHER).otherwise(rules.PATH_PLAIN)
    return F.when(F.size(notes) > 0, F.array_join(F.slice(notes, 1, 2), "; ")).otherwise(plain)


def storyline(two: DataFrame, three: DataFrame, k: int = 10) -> DataFrame:
    """The best k three-hop flows of a sample, or its two-hop flows where it has none, each with a description."""
    shape = lambda df, kind, hops: df.where(F.col("rank") <= k).select("sample_id", F.lit(kind).alias("type"), "rank", F.array(*hops).alias("path"), "combined", "roles", F.array(*[f"t_{h}" for h in hops]).alias("structures"))
    long = shape(three, "three_hop_flow", ["a", "b", "c"])
    rows = long.unionByName(shape(two, "two_hop_flow", ["a", "b"]).join(three.select("sample_id").distinct(), "sample_id", "left_anti"))
    rows = rows.withColumn("narrative", path_narrative(F.col("roles"), F.col("structures")))
    said = F.when(F.size("roles") > 0, joined(F.col("roles"))).otherwise("no explicit behavioral roles")
    return rows.withColumn("description", F.concat(F.array_join("path", " -> "), F.lit(" | score="), F.col("combined").cast("string"), F.lit(" | roles: "), said, F.lit(" | structure: "), F.array_join("structures", " -> "), F.lit(" | narrative: "), F.col("narrative")))


def _some(items: str, n: int, label: str, sep: str = ", ", cut: int | None = None) -> Column:
    first = F.slice(items, 1, n)
    first = first if cut is None else F.transform(first, lambda x: F.substring(x, 1, cut))
    return F.when(F.size(items) > 0, F.concat(F.lit(label), joined(first, sep)))


def function_reasons(enriched: DataFrame) -> DataFrame:
    """Adds reasons, primary_reason, reason_summary and driver_summary to enriched functions."""
    n_in, n_out = F.size("internal"), F.size("external")
    reasons = C.compact(
        _some("hits", 4, "suspicious API mix: "), _some("caps", 3, "local capability evidence: "), _some("roles", 3, "behavior roles: "), _some("strings", 2, "interesting strings: ", " | ", 40),
        F.when((F.col("structure") == "dispatcher") & (n_in >= 8), "dispatcher-like high fan-out control node"), F.when(F.col("structure") == "initializer", "possible bootstrap or early execution function"), F.when(n_out >= 6, "large external API surface concentrated in one function"),
    )
    rows = C.held(enriched, {"reasons": F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("high local score driven by aggregated weak signals")))})
    drivers = C.compact(_some("hits", 3, "apis="), _some("caps", 3, "capabilities="), _some("strings", 2, "strings=", " | ", 25))
    return rows.withColumn("primary_reason", F.element_at("reasons", 1)).withColumn("reason_summary", F.array_join(F.slice("reasons", 1, 3), "; ")).withColumn("driver_summary", F.array_join(drivers, "; "))


def analyst_targets(reasoned: DataFrame, k: int = 8) -> DataFrame:
    """The best k functions of a sample: why, and what to check. reasoned: top functions with reasons and rank; a score above zero has drivers."""
    checks = C.compact(
        F.when(F.col("structure") == "dispatcher", "follow the highest fan-out internal branches first"), F.when(F.col("structure") == "initializer", "inspect bootstrap/setup logic and first-stage callees"), F.when(F.size("hits") > 0, "validate suspicious API call sites and argument flow"),
        F.when(F.size("strings") > 0, "inspect string xrefs and nearby basic blocks"), F.when(F.col("score") > 0, "confirm the top local score drivers in disassembly and decompiler"),
    )
    rows = reasoned.where(F.col("rank") <= k)
    said = F.when(F.size(checks) > 0, F.array_join(checks, "; ")).otherwise("inspect core control flow and first-level callees")
    return rows.withColumn("why", F.concat("reason_summary", F.lit("."))).withColumn("what_to_check", F.concat(said, F.lit(".")))


def inferred_behaviors(samples: DataFrame, capabilities: DataFrame, enriched: DataFrame, three: DataFrame) -> DataFrame:
    """sample_id and behaviors, in rule order: by detected capabilities, by roles anywhere in the sample, by three-hop flows."""
    none = F.array().cast("array<string>")
    caps = capabilities.groupBy("sample_id").agg(F.collect_set("name").alias("caps"))
    roles = enriched.groupBy("sample_id").agg(F.array_distinct(F.flatten(F.collect_set("roles"))).alias("roles"))
    rows = samples.join(caps, "sample_id", "left").join(roles, "sample_id", "left").join(three.select("sample_id").distinct().withColumn("flows", F.lit(True)), "sample_id", "left")
    rows = rows.withColumn("caps", F.coalesce("caps", none)).withColumn("roles", F.coalesce("roles", none))
    found = [F.when(F.array_contains("caps", c), b) for c, b in rules.CAPABILITY_BEHAVIORS.items()] + [F.when(_holds(F.col("roles"), pair), b) for pair, b in rules.PAIR_BEHAVIORS]
    return rows.select("sample_id", C.compact(*found, F.when(F.col("flows"), rules.FLOW_BEHAVIOR)).alias("behaviors"))


def score_drivers(refs: DataFrame, strings: DataFrame, enriched: DataFrame, k: int = 4) -> DataFrame:
    """The k largest parts of each function's score: sample_id, name, rank, type, driver, delta.

    refs: sample_id, name, target, w (weight or null), one row a reference; strings: the rows of function_strings.
    """
    part = lambda df, kind, driver, delta: df.select("sample_id", "name", F.lit(kind).alias("type"), driver.alias("driver"), delta.cast("int").alias("delta"))
    rows = part(refs.where("w is not null"), "suspicious_api", F.col("target"), F.col("w"))
    rows = rows.unionByName(part(strings.where("not benign_hint"), "interesting_string", F.substring("value", 1, 80), F.least("score", F.lit(15))))
    rows = rows.unionByName(part(enriched.where(F.size("caps") > 0), "local_capabilities", F.array_join("caps", ","), F.least(3 * F.size("caps"), F.lit(9))))
    fan = 2 * (F.size("internal") >= 15).cast("int") + 2 * (F.size("external") >= 30).cast("int")
    rows = rows.unionByName(part(enriched.where(fan > 0), "connectivity", F.col("name"), fan))
    few, has = F.size("hits"), lambda c: F.array_contains("caps", c)
    weak = 12 * (has("persistence") & (few <= 2)).cast("int") + 10 * (has("anti_analysis") & (few <= 2)).cast("int") + 10 * (has("dynamic_loading") & F.array_contains("roles", "loader") & (few <= 3)).cast("int")
    weak += 10 * ((F.size("internal") >= 20) & (F.size("external") >= 20) & (few <= 2) & (F.size("caps") <= 1) & (F.size("strings") == 0)).cast("int")
    rows = rows.unionByName(part(enriched.where(weak > 0), "benign_adjustment", F.col("name"), -weak))
    rank = F.row_number().over(W.partitionBy("sample_id", "name").orderBy(F.desc(F.abs("delta")), "type", "driver"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def story_summary(entries: DataFrame, dispatchers: DataFrame, workers: DataFrame, lines: DataFrame) -> DataFrame:
    """sample_id and sentences on where execution starts, who dispatches, who works and the best flow, as far as known.

    entries, dispatchers and workers carry rank, and the first two primary_reason; lines is the storyline.
    """
    first = lambda df: df.where("rank = 1")
    fan = (F.size("internal") + F.size("external")).cast("string")
    parts = [
        first(entries).select("sample_id", F.lit(1).alias("n"), F.concat(F.lit("Likely execution starts around "), "name", F.lit(" (score="), F.col("score").cast("string"), F.lit(", fan_out="), fan, F.lit(") because it looks like an early-stage control node.")).alias("line")),
        first(dispatchers).select("sample_id", F.lit(2).alias("n"), F.concat(F.lit("Primary dispatcher candidate is "), "name", F.lit(" ("), "primary_reason", F.lit(").")).alias("line")),
        workers.where("rank <= 3").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("w")).select("sample_id", F.lit(3).alias("n"), F.concat(F.lit("Most notable worker functions: "), joined(F.transform("w", lambda x: x["name"])), F.lit(".")).alias("line")),
        first(lines).select("sample_id", F.lit(4).alias("n"), F.concat(F.lit("Best reconstructed flow: "), "description", F.lit(".")).alias("line")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("sentences"))
