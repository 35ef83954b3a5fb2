"""Embedding stores in two layouts, keyed field stores, and readers that resolve labels from several places."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unpack_embeddings(files: DataFrame) -> DataFrame:
    """id and vector of files (path, content): an .npy holds one vector named by its file, an .npz `ids` and `emb`.

    Files are read where they lie, a file at a time; objects that would need unpickling are refused.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for path, content in zip(f["path"], f["content"], strict=True):
                name, held = PurePosixPath(path), np.load(io.BytesIO(content), allow_pickle=False)
                ids, vectors = ([name.stem], [held.reshape(-1)]) if name.suffix == ".npy" else (held["ids"].astype(str).tolist(), held["emb"])
                yield pd.DataFrame({"id": ids, "vector": [np.asarray(v, np.float32) for v in vectors]})

    return files.select("path", "content").mapInPandas(run, "id string, vector array<float>")


def load_embeddings(spark: SparkSession, glob: str) -> DataFrame:
    """id and vector of all embedding files that a glob names, in either layout."""
    return unpack_embeddings(spark.read.format("binaryFile").load(glob))


def pack_embeddings(rows: DataFrame, key: str, vec: str, per_file: int) -> DataFrame:
    """path and content of .npz files of about `per_file` vectors of integer keys; with per_file 1, of an .npy for each."""
    pairs = rows.select(F.col(key).alias("k"), F.col(vec).alias("v"), F.floor(F.col(key) / per_file).alias("file"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        out, x = io.BytesIO(), np.array(f["v"].tolist(), np.float32)
        if per_file == 1:
            np.save(out, x[0])
        else:
            np.savez(out, ids=f["k"].astype(str).to_numpy(dtype=str), emb=x)
        return pd.DataFrame({"path": [f"{f['file'].iloc[0]}.{'npy' if per_file == 1 else 'npz'}"], "content": [out.getvalue()]})

    return pairs.groupBy("file").applyInPandas(one, "path string, content binary")


class FieldStore:
    """Fields by key under one policy: a Parquet table in folders by a hash of the key.

    A key's first field stays: appending again adds only new keys, so an interrupted append can be repeated. A store that
    was made under another policy is refused, as its fields would not compare.
    """

    def __init__(self, spark: SparkSession, root: str, policy: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        spark.createDataFrame([(policy, buckets)], "policy string, buckets int").write.mode("ignore").json(f"{self.root}/policy")
        held = spark.read.schema("policy string, buckets int").json(f"{self.root}/policy").head()
        if tuple(held) != (policy, buckets):
            raise ValueError(f"{self.root} holds fields of policy {held['policy']!r} in {held['buckets']} folders, not of {policy!r} in {buckets}")
        empty = spark.createDataFrame([], "key string, values array<double>, bucket int")
        empty.write.mode("ignore").partitionBy("bucket").parquet(f"{self.root}/fields")

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def fields(self) -> DataFrame:
        return self.spark.read.schema("key string, values array<double>, bucket int").parquet(f"{self.root}/fields")

    def missing(self, keys: DataFrame) -> DataFrame:
        """Rows whose key has no field."""
        return keys.withColumn("bucket", self._bucket("key")).join(self.fields().select("bucket", "key"), ["bucket", "key"], "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Adds key and values of new keys; of a key that comes repeatedly the least field."""
        one = rows.where("key is not null").groupBy("key").agg(F.min("values").alias("values"))
        new = self.missing(one).select("key", "values", "bucket")
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/fields")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key and values of those of the given keys that have a field; only their folders are read."""
        wanted = keys.select("key").distinct().withColumn("bucket", self._bucket("key"))
        return self.fields().join(wanted, ["bucket", "key"]).select("key", "values")


def class_name(value: Column, classes: Sequence[str]) -> Column:
    """A class by its name or by its number from 0, both as text; null for anything else."""
    names = F.array(*map(F.lit, classes))
    return F.when(value.isin(*classes), value).otherwise(F.try_element_at(names, value.try_cast("int") + 1))


def resolve_classes(rows: DataFrame, sidecars: DataFrame, key: Sequence[str], own: str, classes: Sequence[str], registered: DataFrame, labeled_only: bool = False) -> DataFrame:
    """rows of registered batches with `klass`: their own label, else the sidecars' last one (by `nth`) that is a class.

    sidecars holds the key columns, nth and value. What is no class never hides an earlier label. registered holds `batch`.
    """
    said = sidecars.select(*key, "nth", class_name(F.col("value"), classes).alias("_class")).where("_class is not null")
    last = said.groupBy(*key).agg(F.max_by("_class", F.struct("nth", "_class")).alias("_side"))
    known = rows.join(registered.select("batch").distinct(), "batch", "left_semi").join(last, list(key), "left")
    out = known.withColumn("klass", F.coalesce(class_name(F.col(own), classes), "_side")).drop("_side")
    return out.where("klass is not null") if labeled_only else out
