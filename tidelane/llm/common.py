"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a broadcast side may have; both are measured before it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. One of this machine is
    made only where none is named and Spark runs in this one process; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidelane-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint, so that a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder: columns that a reader doesn't want stay there."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """df, its lineage cut, with a broadcast hint if it is measured to be within both bounds;
    otherwise Spark shuffles both sides."""
    df = cut(df)
    width = sum((_bytes(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(16))
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return df.hint("broadcast") if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def set_aside(docs: DataFrame, needed: set[str]) -> DataFrame:
    """docs with every column but the needed ones named `in_...`, which no working column is."""
    return docs.select(*(F.col(c) if c in needed else F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns))


def as_given(names: list[str], needed: set[str]) -> list[Column]:
    """The columns that set_aside renamed, under their own names again."""
    return [F.col(c) if c in needed else F.col(f"`in_{c}`").alias(c) for c in names]
