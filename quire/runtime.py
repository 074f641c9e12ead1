"""Session helpers shared by all operators: tables, checkpoints, size-checked broadcasts, worker shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of a table that may be broadcast; both are measured before.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it lies in the folder; only the columns a plan uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, batch_rows: int = 4000) -> None:
    """Session settings that bound the memory of Python workers: small Arrow batches, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # an older Spark has no such setting
        pass
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers: they know the driver's environment and folder at most, never its ``sys.path``."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if not (sc.master.startswith("local") and root in [*known, os.getcwd()]):
        out = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire_pkg.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(os.path.join(root, "quire")):
                for f in files:
                    if f.endswith(".py"):
                        p = os.path.join(folder, f)
                        z.write(p, os.path.relpath(p, root))
        sc.addPyFile(out)
    sc._quire_shipped = True


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the folder that the session names in ``spark.checkpoint.dir``. Where it is unset, a private folder serves a
    session in one process; a cluster without a shared folder is refused. Files go with the frames that read them.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quire-ckpt-")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=eager)


def byte_size(df: DataFrame):
    """The bytes of a row's values, as a column: lengths of texts, and of other values as JSON."""
    return sum((F.coalesce(F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in df.schema.fields), F.lit(0))


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A side of a join: broadcast after its rows and bytes were measured and are few, else left to a shuffled join."""
    kept = checkpointed(df)
    n, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(byte_size(kept)), F.lit(0))).first()
    return F.broadcast(kept) if n <= rows and total <= size else kept.hint("merge")


def each_small_or_shuffled(*kept: DataFrame) -> list[DataFrame]:
    """As ``small_or_shuffled``, for several sides that read checkpoints: one query measures them all."""
    parts = [k.select(F.lit(i).alias("side"), byte_size(k).alias("bytes")) for i, k in enumerate(kept)]
    measured = {r["side"]: (r["n"], r["total"]) for r in reduce(DataFrame.unionAll, parts).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")).collect()}
    few = [n <= BROADCAST_ROWS and total <= BROADCAST_BYTES for n, total in (measured.get(i, (0, 0)) for i in range(len(kept)))]
    return [F.broadcast(k) if f else k.hint("merge") for k, f in zip(kept, few)]


def collect_bounded(df: DataFrame, rows: int, what: str) -> list:
    """Rows of a control table (containers, test items, ...) for the driver; refuses a table above its stated bound."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what}: more than {rows} rows; this control table must be small")
    return got


#: Bytes of a scan up to which ``spread`` deals rows out by a shuffle.
SPREAD_BYTES = 2 << 30


def spread(df: DataFrame) -> DataFrame:
    """More partitions before a Python kernel where a scan has fewer than the session has cores: a small scan is dealt out, a larger one is read in smaller splits, so its texts are never shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if plan.toRdd().getNumPartitions() >= cores:
        return df
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size <= SPREAD_BYTES:
        return df.repartition(cores)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(4 << 20, size // (2 * cores))))
    return df.select("*")


def arrow_map(df: DataFrame, kernel, schema: str) -> DataFrame:
    """``mapInArrow`` over record batches; ``kernel`` gets and returns one pyarrow RecordBatch (or None for no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = kernel(b)
                if out is not None:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the place (from 1) of each row within its group by ``order``, without sorting a group in one task.

    Rows are range-partitioned by group and order, numbered inside their partition, and the partitions of a group get offsets from a table of counts. A hot group is spread over as many
    tasks as it has ranges. ``order`` must decide between any two rows of a group.
    """
    cols = df.columns
    parts = df.repartitionByRange(*[F.col(c) for c in (group, *order)]).withColumn("_part", F.spark_partition_id())
    kept = checkpointed(parts)
    w = Window.partitionBy(group, "_part").orderBy(*order)
    inner = kept.withColumn("_r", F.row_number().over(w))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = kept.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = inner[group].eqNullSafe(offs[group]) & (inner["_part"] == offs["_part"])
    return inner.join(F.broadcast(offs) if kept.rdd.getNumPartitions() <= 2000 else offs, same).select(*[inner[c] for c in cols], (inner["_r"] + offs["_off"]).cast("int").alias(name))
