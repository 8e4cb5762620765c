"""Function enrichment: local scores, roles, structure and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import columns as C, rules
from .apis import _memberships


def enrich_functions(functions: DataFrame, refs: DataFrame, calls: DataFrame, canonical_roles: bool = False, strings: DataFrame | None = None) -> DataFrame:
    """Every function with its score, risk, roles, capabilities, calls and structure role.

    References are a bag: each one adds its API's weight. Roles probe raw names against canonical calls, as the rules
    are written; canonical_roles=True probes canonical names instead. strings: the rows of function_strings; their
    points, tags and best twelve count where they are given.
    """
    api = refs.select("sample_id", "name", C.canonical(F.col("api")).alias("target"), C.weight(F.col("api")).alias("w"))
    local = api.groupBy("sample_id", "name").agg(F.sum(F.coalesce("w", F.lit(0))).alias("api_score"), F.collect_set("target").alias("external"), F.collect_set(F.when(F.col("w").isNotNull(), F.col("target"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set(_memberships(F.col("target"))))).alias("caps"))
    out = calls.groupBy("sample_id", F.col("caller").alias("name")).agg(F.collect_set("callee").alias("internal"))
    into = calls.groupBy("sample_id", F.col("callee").alias("name")).agg(F.count("*").cast("int").alias("incoming"))
    rows = functions.select("sample_id", "name", "ord").join(local, ["sample_id", "name"], "left").join(out, ["sample_id", "name"], "left").join(into, ["sample_id", "name"], "left")
    none = F.array().cast("array<string>")
    if strings is None:
        rows = rows.withColumn("string_score", F.lit(0)).withColumn("string_tags", none).withColumn("strings", none)
    else:
        rows = rows.join(string_evidence(strings), ["sample_id", "name"], "left").withColumn("string_score", F.coalesce("string_score", F.lit(0))).withColumn("string_tags", F.coalesce("string_tags", none)).withColumn("strings", F.coalesce("strings", none))
    rows = C.held(rows, {c: F.array_sort(F.coalesce(c, none)) for c in ("external", "hits", "caps", "internal")})
    name = rules.canonical_name if canonical_roles else (lambda a: a)
    tag_roles = {"network": "networking", "persistence": "persistence", "anti_analysis": "anti_analysis", "crypto": "crypto", "execution": "execution"}
    role = lambda r: F.arrays_overlap("external", F.array(*[F.lit(name(a)) for a in rules.ROLE_APIS[r]])) | (F.array_contains("caps", tag_roles[r]) | F.array_contains("string_tags", tag_roles[r]) if r in tag_roles else F.lit(False))
    rows = C.held(rows, {"roles": F.array_sort(C.compact(*[F.when(role(r), r) for r in rules.ROLE_APIS]))})
    has = lambda c: F.array_contains("caps", c)
    few = F.size("hits")
    change = F.least(3 * F.size("caps"), F.lit(9)) + 2 * (F.size("internal") >= 15).cast("int") + 2 * (F.size("external") >= 30).cast("int")
    change -= 12 * (has("persistence") & (few <= 2)).cast("int") + 10 * (has("anti_analysis") & (few <= 2)).cast("int") + 10 * (has("dynamic_loading") & F.array_contains("roles", "loader") & (few <= 3)).cast("int")
    change -= 10 * ((F.size("internal") >= 20) & (F.size("external") >= 20) & (few <= 2) & (F.size("caps") <= 1) & (F.size("strings") == 0)).cast("int")
    rows = rows.withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    rows = rows.withColumn("score", F.least(F.greatest(F.coalesce("api_score", F.lit(0)) + F.col("string_score") + change, F.lit(0)), F.lit(45)).cast("int"))
    n_in, n_out = F.size("internal"), F.size("external")
    structure = F.when((F.col("incoming") == 0) & (n_in + n_out >= 8), "initializer").when((n_in >= 8) & (n_in + n_out >= 15), "dispatcher").when((n_in >= 3) & (n_out >= 3), "worker").when(n_in + n_out >= 6, "worker").otherwise("leaf")
    return rows.withColumn("risk", C.function_risk(F.col("score"))).withColumn("structure", structure).withColumn("drivers", _drivers()).drop("api_score", "string_score", "string_tags")


def function_strings(refs: DataFrame, interesting: DataFrame) -> DataFrame:
    """One row per function and address, however often it is referenced: refs (sample_id, name, address) by interesting strings."""
    return refs.select("sample_id", "name", "address").distinct().join(interesting, ["sample_id", "address"])


def string_evidence(found: DataFrame, k: int = 12) -> DataFrame:
    """sample_id, name, string_score (at most 15 a string, vendors' none), string_tags and strings: the best k values."""
    best = F.row_number().over(W.partitionBy("sample_id", "name").orderBy(F.desc("score"), "value", "address"))
    points = F.when(F.col("benign_hint"), 0).otherwise(F.least("score", F.lit(15)))
    kept = F.collect_list(F.when(F.col("r") <= k, F.struct("r", "value")))
    out = found.withColumn("r", best).groupBy("sample_id", "name").agg(F.sum(points).alias("string_score"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("string_tags"), kept.alias("kept"))
    return out.select("sample_id", "name", "string_score", "string_tags", F.transform(F.array_sort("kept"), lambda x: x["value"]).alias("strings"))


def _drivers() -> F.Column:
    """Largest parts of a score: the capability bonus and the adjustment, in order of size."""
    bonus = F.least(3 * F.size("caps"), F.lit(9))
    return F.array_sort(C.compact(F.when(bonus > 0, F.concat(F.lit("local_capabilities:"), bonus.cast("string")))))


def top_functions(enriched: DataFrame, k: int = 25) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "name"))
    return enriched.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def capability_support(enriched: DataFrame) -> DataFrame:
    """sample_id, name, local, medium, top: functions that support each capability by match or role."""
    alias = {"network": "networking", "injection": "process_injection", "loader": "dynamic_loading", "crypto": "crypto", "persistence": "persistence", "anti_analysis": "anti_analysis"}
    implied = F.array_distinct(F.concat("caps", C.compact(*[F.when(F.array_contains("roles", r), c) for r, c in alias.items()])))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "name"))
    rows = enriched.withColumn("rank", rank).select("sample_id", "score", "rank", F.explode(implied).alias("name"))
    return rows.groupBy("sample_id", "name").agg(F.count("*").cast("int").alias("local"), F.count_if(F.col("score") >= 15).cast("int").alias("medium"), F.count_if((F.col("rank") <= 25) & (F.col("score") > 0)).cast("int").alias("top"))


def behavior_clusters(enriched: DataFrame, k: int = 10) -> DataFrame:
    rows = enriched.select("sample_id", F.explode("roles").alias("role"), "name", "score")
    rank = F.row_number().over(W.partitionBy("sample_id", "role").orderBy(F.desc("score"), "name"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def hub_functions(enriched: DataFrame, k: int = 12, least: int = 12) -> DataFrame:
    rows = enriched.withColumn("connectivity", F.size("internal") + F.size("external")).where((F.col("connectivity") >= least) & ((F.col("score") >= 15) | (F.size("roles") > 0)))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("connectivity"), F.desc("incoming"), F.desc("score"), "name"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def story_functions(enriched: DataFrame, kind: str) -> DataFrame:
    """Initialisers, dispatchers or workers, in their story order."""
    n_in, n_out = F.size("internal"), F.size("external")
    order, k, test = {
        "initializer": ([F.desc("score"), F.desc(n_in), "name"], 8, F.col("structure") == "initializer"),
        "dispatcher": ([F.desc(n_in + n_out), F.desc("score"), "name"], 8, F.col("structure") == "dispatcher"),
        "worker": ([F.desc("score"), F.desc("incoming"), "name"], 12, (F.col("structure") == "worker") & ((F.col("score") >= 10) | (F.size("roles") > 0))),
    }[kind]
    return enriched.where(test).withColumn("rank", F.row_number().over(W.partitionBy("sample_id").orderBy(*order))).where(F.col("rank") <= k)
