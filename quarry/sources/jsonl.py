"""JSON-lines and sidecar readers and writers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder named by spark.checkpoint.dir; a temporary folder only where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line under an explicit schema; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_torn(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and one row with the number of lines that are no JSON; none is dropped in silence."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.try_parse_json("value").isNull().alias("_torn"))
    sound = lines.where("not _torn").select(F.from_json("value", schema).alias("r")).select("r.*")
    return sound, lines.agg(F.count_if("_torn").alias("torn"))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """A commit to an append-only log: one write is one commit, files appear only when it is whole."""
    df.write.mode("append").json(path)


def read_batches(spark: SparkSession, glob: str, schema: T.StructType, depth: int = 2) -> DataFrame:
    """All files of a glob with batch, the name of the folder `depth` levels above each file's folder end."""
    return spark.read.schema(schema).json(glob).withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth))


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON document, or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def field(line: Column, key: str, kind: str) -> Column:
    """A field of a JSON text by key; null if it is absent or not of that kind."""
    return F.get_json_object(line, f"$.{key}").try_cast(kind)


def sidecar(files: DataFrame, text: str, *keep: str) -> DataFrame:
    """id and value of label maps in any of three shapes: {id: v}, {"labels": {id: v}}, {id: {"score": v}}; nulls are dropped."""
    inner = F.coalesce(F.get_json_object(text, "$.labels"), F.col(text))
    pairs = files.select(*keep, F.explode(F.from_json(inner, "map<string,string>")).alias("id", "_v"))
    value = F.coalesce(F.get_json_object("_v", "$.score"), F.col("_v")).try_cast("int")
    return pairs.select(*keep, "id", value.alias("value")).where("value is not null")


def read_field(spark: SparkSession, glob: str, kind: str = "f4") -> DataFrame:
    """path and values of raw little-endian grids; NaN marks the inside."""

    @F.pandas_udf("array<double>")
    def values(content: pd.Series) -> pd.Series:
        return content.map(lambda b: np.frombuffer(b, f"<{kind}").astype(float).tolist())

    return spark.read.format("binaryFile").load(glob).select("path", F.transform(values("content"), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("values"))  # Arrow hands NaN over as null
