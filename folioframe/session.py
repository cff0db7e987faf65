"""Session helpers: defaults, checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import operator
import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# Rows a side may hold before it is no longer broadcast.
BROADCAST_ROWS = 500_000
# ... and their bytes
BROADCAST_BYTES = 64 << 20


def build_session(master: str = "local[8]", app: str = "folioframe",
                  shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where that is unset, one master process (local mode, tests) gets a temporary folder that its only executor sees
    too; on a cluster the setting is required, as executors do not see each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting cannot be changed in a running session, so the folder is remembered here
        context = spark.sparkContext
        root = context.__dict__.setdefault("_folioframe_folder", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context._folioframe_folder = root
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession, root: str) -> None:
    """Send this package to the Python workers once per application; they need no path to the repository."""
    context = spark.sparkContext
    if getattr(context, "_folioframe_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-")      # read by this driver only, which serves it to the executors
    target = os.path.join(folder, "folioframe_package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for base, _, names in os.walk(os.path.join(root, "folioframe")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    context._folioframe_shipped = True


def materialize(df: DataFrame, label: str, partition_by: list | None = None) -> DataFrame:
    """Cut lineage with a parquet copy in the shared folder, in a folder per value of ``partition_by``; survives a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    A large table has many more splits than that and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _width(kind: DataType) -> int:
    """Bytes of a value of fixed size, or of one of an array's items."""
    if isinstance(kind, StructType):
        return 8 + sum(_width(f.dataType) for f in kind.fields)
    return 24 if isinstance(kind, (StringType, BinaryType, ArrayType, MapType)) else 8


def _bytes(name: str, kind: DataType) -> Column:
    """Bytes of a column's value: texts and arrays by their length."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType)):
        items = _width(kind.elementType) if isinstance(kind, ArrayType) else _width(kind.keyType) + _width(kind.valueType)
        return F.greatest(F.size(col), F.lit(0)) * items + 8
    return F.lit(_width(kind))


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven to hold at most ``max_rows`` rows of about ``max_bytes`` together (scans no further)."""
    size = reduce(operator.add, [_bytes(f.name, f.dataType).cast("long") for f in df.schema.fields])
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after rows and bytes were checked; otherwise leave the plan to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df
