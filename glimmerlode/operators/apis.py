"""API surface: canonical names, weights, capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, rules


def suspicious_apis(symbols: DataFrame) -> DataFrame:
    """Per sample and canonical name: the largest weight and the names seen."""
    rows = symbols.select("sample_id", "symbol", C.canonical(F.col("symbol")).alias("name"), C.weight(F.col("symbol")).alias("w")).where("w is not null")
    return rows.groupBy("sample_id", "name").agg(F.max("w").alias("weight"), F.array_sort(F.collect_set("symbol")).alias("variants"))


def _memberships(api: F.Column) -> F.Column:
    """Capabilities that a canonical API belongs to."""
    return C.compact(*[F.when(api.isin(rules.canonical_apis(c)), c) for c in rules.CAPABILITIES])


def detect_capabilities(symbols: DataFrame) -> DataFrame:
    """Capabilities whose distinct canonical matches reach their least count."""
    rows = symbols.select("sample_id", C.canonical(F.col("symbol")).alias("api")).distinct()
    rows = rows.select("sample_id", "api", F.explode(_memberships(F.col("api"))).alias("name"))
    found = rows.groupBy("sample_id", "name").agg(F.count("*").cast("int").alias("match_count"), F.array_sort(F.collect_set("api")).alias("matched_apis"))
    least = F.coalesce(*[F.when(F.col("name") == n, r[1]) for n, r in rules.CAPABILITIES.items()])
    base = F.coalesce(*[F.when(F.col("name") == n, r[2]) for n, r in rules.CAPABILITIES.items()])
    found = found.withColumn("min_matches", least).withColumn("base", base).where("match_count >= min_matches")
    found = found.withColumn("confidence", C.capability_confidence(F.col("name"), F.col("match_count"), F.col("min_matches")))
    bonus = F.when(F.col("confidence") == "high", 8).when(F.col("confidence") == "medium", 3).otherwise(0)
    return found.withColumn("score", F.col("base") + bonus).withColumn("source", F.lit("global_import_surface")).drop("base")


def reconcile_capabilities(detected: DataFrame, support: DataFrame, strong: DataFrame) -> DataFrame:
    """Detected capabilities against local support (sample_id, name, matched, local, medium, top); strong: samples that import strong injection APIs."""
    base = F.coalesce(*[F.when(F.col("name") == n, r[2]) for n, r in rules.CAPABILITIES.items()])
    rows = detected.select("sample_id", "name", "match_count", F.col("confidence").alias("c0"), F.col("score").alias("s0"), "source").join(support, ["sample_id", "name"], "full").join(strong.select("sample_id").distinct().withColumn("strong", F.lit(True)), "sample_id", "left")
    rows = rows.withColumn("base", base).withColumn("here", F.col("c0").isNotNull()).withColumn("soft", F.col("name").isin(rules.SOFT))
    for c in ("local", "medium", "top"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    here, soft, local, top = F.col("here"), F.col("soft"), F.col("local"), F.col("top")
    weak = here & soft & (local <= 1) & (F.col("match_count") <= F.coalesce(*[F.when(F.col("name") == n, r[1]) for n, r in rules.CAPABILITIES.items()]))
    many_soft = here & soft & (local >= 2)
    many = here & ~soft & (local >= 2) & (top >= 1)
    add_net = ~here & (F.col("name") == "networking") & (local >= 2) & (F.col("medium") >= 1)
    add_inj = ~here & (F.col("name") == "process_injection") & (local >= 2) & (F.col("medium") >= 1) & F.coalesce("strong", F.lit(False))
    add_dyn = ~here & (F.col("name") == "dynamic_loading") & (local >= 2) & (top >= 1)
    confidence = F.when(weak, "low").when(many_soft, "medium").when(many & (F.col("c0") == "low"), "medium").when(here, F.col("c0")).when(add_net, F.when(top == 0, "medium").otherwise("high")).when(add_inj | add_dyn, "medium")
    score = F.when(weak, F.greatest(F.lit(4), F.least("s0", "base"))).when(many_soft, F.greatest(F.col("s0"), F.col("base") + 3)).when(many, F.greatest(F.col("s0"), F.col("base") + 6)).when(here, F.col("s0")).when(add_net, F.col("base") + 6).when(add_inj, F.col("base") + 5).when(add_dyn, F.col("base") + 2)
    suffix = F.when(weak, "+weak_local_support").when(many_soft | many, "+multi_function_local_evidence").otherwise("")
    return rows.select("sample_id", "name", confidence.alias("confidence"), score.cast("int").alias("score"), F.when(here, F.concat("source", suffix)).otherwise("local_function_evidence").alias("source")).where("confidence is not null")
