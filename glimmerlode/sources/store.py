"""Stored intermediates: facts and enrichments written once as Parquet in the shared folder, then read by any query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df under spark.checkpoint.dir (a folder of its own only where none is set) and read it back."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='glimmerlode-')}")
    path = f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
