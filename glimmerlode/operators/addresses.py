"""Addresses: which range holds one, and where a program starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAGE = 4096


def containing(points: DataFrame, ranges: DataFrame, columns: list[str], page: int = PAGE) -> DataFrame:
    """points (sample_id, address, ...) with `columns` of the range that holds the address, null where none does.

    ranges: sample_id, start, end (exclusive) and columns; the ranges of a sample are disjoint, as functions and memory
    blocks are, and empty ones hold nothing. Both sides meet by sample and page, so a large sample spreads over its pages
    and a range is repeated once for each page that it touches.
    """
    pages = F.explode(F.sequence(F.floor(F.col("start") / page), F.floor((F.col("end") - 1) / page)))
    held = ranges.where("end > start").select("sample_id", pages.alias("page"), "start", "end", *columns)
    p, r = points.withColumn("page", F.floor(F.col("address") / page)).alias("p"), held.alias("r")
    on = (F.col("p.sample_id") == F.col("r.sample_id")) & (F.col("p.page") == F.col("r.page")) & (F.col("p.address") >= F.col("r.start")) & (F.col("p.address") < F.col("r.end"))
    return p.join(r, on, "left").select("p.*", *[F.col(f"r.{c}").alias(c) for c in columns]).drop("page")


def entry_points(programs: DataFrame, blocks: DataFrame) -> DataFrame:
    """sample_id, address, section, is_executable, is_writable of each program's entry.

    programs: sample_id, external (addresses in order, nulls skipped), image_base, min_address; the first that is known is
    the entry. blocks: sample_id, start, end, name, x, w. Outside every block the section is unknown and has no flags.
    """
    address = F.coalesce(F.get(F.filter("external", lambda a: a.isNotNull()), F.lit(0)), "image_base", "min_address")
    found = containing(programs.select("sample_id", address.alias("address")), blocks, ["name", "x", "w"])
    flag = lambda c: F.coalesce(c, F.lit(False))
    return found.select("sample_id", "address", F.coalesce("name", F.lit("unknown")).alias("section"), flag("x").alias("is_executable"), flag("w").alias("is_writable"))
