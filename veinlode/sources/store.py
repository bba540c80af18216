"""Tables, record files and small stores: reading, idempotent appending, merging, and cutting lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a checkpoint in the shared folder. Where none is named, a local session gets a
    temporary one; on a cluster, whose executors couldn't share that, it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veinlode-"))
    return df.checkpoint(eager=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """IO01: JSON objects by line; a bad line fails the read, or with ``strict`` off lands in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    audit = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(audit).json(path, mode="PERMISSIVE")


def new_rows(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """IO02, IO20: incoming rows whose key isn't stored, one per key; a null key is an error."""
    checked = incoming.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"record without {key}"))).otherwise(F.col(key)))
    return checked.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def append_jsonl(spark: SparkSession, path: str, incoming: DataFrame, key: str) -> None:
    """IO02: append the new rows; running it twice stores them once."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    stored = spark.read.schema(incoming.schema).json(path) if exists else incoming.limit(0)
    new_rows(stored, incoming, key).write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO03: replace the whole folder, committed at the end."""
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, accepted: F.Column, accepted_path: str, audit_path: str) -> dict[str, int]:
    """IO04: accepted rows and the full audit, with counters, from one cached pass."""
    kept = df.withColumn("_ok", F.coalesce(accepted, F.lit(False))).persist()
    try:
        kept.drop("_ok").write.mode("overwrite").json(audit_path)
        kept.where("_ok").drop("_ok").write.mode("overwrite").json(accepted_path)
        row = kept.agg(F.count("*").alias("n"), F.count_if("_ok").alias("k")).first()
        return {"seen": row.n, "accepted": row.k, "rejected": row.n - row.k}
    finally:
        kept.unpersist()


def merge_sparse(rows: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """IO18: (key, values as a map), the last value of each name winning; ``rows`` are long (key, name, value, order)."""
    last = rows.groupBy(key, name).agg(F.max_by(value, order).alias(value))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias("values"))


def last_per_key(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """SX55, WN01: the row with the greatest ``order`` of each key, by partial aggregation instead of a sort."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def sections(spark: SparkSession, path: str) -> DataFrame:
    """IO22, IO23: Markdown files cut at second-level headings: (file, position, title, body, card_id)."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("file"), "value")
    return cut_sections(text)


def cut_sections(text: DataFrame) -> DataFrame:
    """(file, value) to sections; what stands before the first heading is no section."""
    parts = text.select("file", F.posexplode(F.split("value", r"(?m)^## ")).alias("position", "part")).where("position > 0")
    title = F.trim(F.regexp_extract("part", r"^([^\n]*)", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace("part", r"^[^\n]*", ""), r"\s+", " "))
    key = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return parts.select("file", "position", title.alias("title"), body.alias("body"), F.concat_ws("-", "file", key).alias("card_id"))


def totals_by_folder(rows: DataFrame, path: str, value: str) -> DataFrame:
    """IO25: the sum of a value by the first segment of the path."""
    return rows.groupBy(F.split(path, "/")[0].alias("folder")).agg(F.sum(value).alias("total"))


def write_tables(root: str, **frames: DataFrame) -> dict[str, DataFrame]:
    """SX01, SX03: each table as Parquet below ``root``, replaced where it is there, and read from there."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in frames.items()}
