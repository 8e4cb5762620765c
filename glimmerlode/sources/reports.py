"""Stored reports: catalogue, kinds, companions, readers and the JSON and Markdown sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

SAMPLE_NAMES = r"(?i)\.(exe|dll|sys|scr|drv|ocx|cpl|bin)$"


def sample_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, at any depth, that look like samples; names that start with a dot are left."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("path").rlike(SAMPLE_NAMES)).orderBy("path")


def kind(path: Column) -> Column:
    """raw, ai or enriched, by the end of the name."""
    return F.when(path.endswith("_raw.json"), "raw").when(path.endswith("_ai.json"), "ai").when(path.endswith(".json"), "enriched").otherwise("other")


def companion(path: Column) -> Column:
    """The raw report of an enriched one and the other way round."""
    return F.when(path.endswith("_raw.json"), F.regexp_replace(path, r"_raw\.json$", ".json")).when(path.endswith("_ai.json"), None).when(path.endswith(".json"), F.regexp_replace(path, r"\.json$", "_raw.json"))


def latest(reports: DataFrame) -> DataFrame:
    """reports: path, modified. The newest that is no AI report, as its enriched form if that exists."""
    rows = reports.withColumn("kind", kind(F.col("path"))).where("kind in ('raw', 'enriched')")
    top = rows.orderBy(F.desc("modified"), F.desc("path")).limit(1)
    better = rows.select(F.col("path").alias("other"))
    return top.join(better, F.when(F.col("kind") == "raw", companion(F.col("path"))) == F.col("other"), "left").select(F.coalesce("other", "path").alias("path"), "modified")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Any report as one variant column v and its path; fields are read with variant_get."""
    return spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).select("v", F.input_file_name().alias("path"))


def field(report: Column, dotted: str, kind_: str = "string") -> Column:
    """A field by dotted path, null where it is missing or of another kind."""
    return F.try_variant_get(report, f"$.{dotted}", kind_)


def pretty(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def markdown(summary: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """sample_id, markdown: a fixed order of sections, each with its lines or None. parts: title -> (sample_id, rank, line)."""
    out = summary.select("sample_id", F.concat(F.lit("# Report "), F.col("sample_id").cast("string")).alias("markdown"))
    for title, rows in parts.items():
        lines = rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("lines"))
        out = out.join(lines, "sample_id", "left").withColumn("markdown", F.concat("markdown", F.lit(f"\n\n## {title}\n"), F.coalesce("lines", F.lit("None")))).drop("lines")
    return out


def ranked(reports: DataFrame) -> DataFrame:
    return reports.withColumn("rank", F.row_number().over(W.orderBy("modified", "path")))
