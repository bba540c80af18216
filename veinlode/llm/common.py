"""Helpers that the operators share: tables, materialisation, and Arrow-batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space of the word definitions used by the text operators, as a Java pattern class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; a cluster's executors couldn't read one, so it raises.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veinlode-"))
        found = sc.getCheckpointDir()
    return found


#: Session setting: rows that the JVM gathers for a Python worker at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a short lineage that outlives any executor.

    ``rows`` bounds the Arrow batches of this write alone, for plans that hand whole texts to Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows or before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def join_split(big: DataFrame, small: DataFrame, key: str, own: F.Column, hot: int = 1000, counted: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, one row per ``key``, without a hot key in one task.

    A key with over 1 / ``hot`` of the rows of ``big`` is split: its rows are dealt by the hash of ``own`` to parts of
    about that size, and its row of ``small`` is copied to each. There are fewer than ``hot`` such keys, which bounds
    the table of them that is broadcast. Keys are counted in ``counted``, a written table (``big`` itself, where none is named).
    """
    counted = big if counted is None else counted
    parts, part = fresh("_parts", [*big.columns, *small.columns]), fresh("_part", [*big.columns, *small.columns])
    each = max(1.0, counted.count() / hot)
    common = counted.groupBy(key).agg(F.count("*").alias(parts)).where(F.col(parts) > each).select(key, F.ceil(F.col(parts) / each).cast("int").alias(parts))
    common = F.broadcast(materialise(common))
    some = F.coalesce(F.pmod(F.xxhash64(own), F.col(parts)).cast("int"), F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))
    left = big.join(common, key, "left").withColumn(part, some).drop(parts)
    right = small.join(common, key, "left").withColumn(part, every).drop(parts)
    return left.join(right, [key, part]).drop(part)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened until it clashes with no column in ``taken`` (compared without case, as Spark does)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def map_batches(
    df: DataFrame,
    inputs: dict[str, F.Column],
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[dict[str, pa.Array]], tuple[list, Sequence[int] | None]]],
    rows: int = 1000,
) -> DataFrame:
    """Append ``fields`` to the columns ``keep``, a record batch at a time.

    ``make()`` runs once per task and returns a function from a batch's input arrays to (one list
    or array per field, row numbers to keep or None for all). Batches have ``rows`` rows at most, so
    a task holds one batch besides what ``make()`` builds.
    """
    names = [f"_in{i}" for i in range(len(inputs))]
    carried = [f"_keep{i}" for i in range(len(keep))]
    wide = df.select(
        *[df[f"`{c}`"].alias(a) for c, a in zip(keep, carried)], *[e.alias(a) for e, a in zip(inputs.values(), names)]
    )
    out = T.StructType(
        [T.StructField(a, df.schema[c].dataType) for c, a in zip(keep, carried)]
        + [T.StructField(f"_out{i}", t) for i, (_, t) in enumerate(fields)]
    )
    kinds = [to_arrow_type(t) for _, t in fields]
    keys, n_keep = list(inputs), len(keep)
    labels = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns, chosen = work(dict(zip(keys, batch.columns[n_keep:])))
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(columns, kinds)]
                old = batch.columns[:n_keep]
                if chosen is not None:
                    chosen = pa.array(chosen, type=pa.int64())
                    old = [c.take(chosen) for c in old]
                yield pa.RecordBatch.from_arrays([*old, *made], labels)

    done = wide.mapInArrow(run, out)
    return done.select(
        *[done[a].alias(c) for c, a in zip(keep, carried)],
        *[done[f"_out{i}"].alias(n) for i, (n, _) in enumerate(fields)],
    )
