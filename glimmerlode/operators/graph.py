"""Call graph: edges, counts, two-hop and three-hop flows with bounded fan-out before each join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W


def edges(enriched: DataFrame) -> DataFrame:
    part = lambda c, kind: enriched.select("sample_id", F.col("name").alias("source"), F.explode(c).alias("target"), F.lit(kind).alias("type"))
    return part("internal", "internal").unionByName(part("external", "external"))


def counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("sample_id").agg(F.count("*").alias("nodes"), F.sum(F.size("internal") + F.size("external")).alias("edges"))


def _seeds(enriched: DataFrame, least: int, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "name"))
    return enriched.where((F.col("score") >= least) | (F.size("roles") > 0)).withColumn("r", rank).where(F.col("r") <= k)


def _hop(rows: DataFrame, enriched: DataFrame, internal: str, fan: int, to: str) -> DataFrame:
    """Follow the first `fan` callees by name; internal calls are sorted already."""
    nodes = enriched.select("sample_id", F.col("name").alias(to), F.col("score").alias(f"s_{to}"), F.col("roles").alias(f"r_{to}"), F.col("structure").alias(f"t_{to}"), F.col("internal").alias(f"i_{to}"))
    return rows.withColumn(to, F.explode(F.slice(internal, 1, fan))).join(nodes, ["sample_id", to])


def _start(enriched: DataFrame, least: int, k: int) -> DataFrame:
    return _seeds(enriched, least, k).select("sample_id", F.col("name").alias("a"), F.col("score").alias("s_a"), F.col("roles").alias("r_a"), F.col("structure").alias("t_a"), F.col("internal").alias("i_a"))


def two_hop(enriched: DataFrame, k: int = 30) -> DataFrame:
    rows = _hop(_start(enriched, 15, 50), enriched, "i_a", 10, "b")
    rows = rows.withColumn("combined", F.col("s_a") + F.col("s_b")).withColumn("roles", F.array_distinct(F.concat("r_a", "r_b"))).where((F.col("combined") >= 20) | (F.size("roles") > 0))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("combined"), "a", "b"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def three_hop(enriched: DataFrame, k: int = 25) -> DataFrame:
    rows = _hop(_hop(_start(enriched, 20, 35), enriched, "i_a", 6, "b"), enriched, "i_b", 6, "c").where("c <> a")
    rows = rows.withColumn("combined", F.col("s_a") + F.col("s_b") + F.col("s_c")).withColumn("roles", F.array_distinct(F.concat("r_a", "r_b", "r_c"))).where((F.col("combined") >= 35) | (F.size("roles") > 0))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("combined"), "a", "b", "c"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
