"""Session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(app: str = "keyloom", cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the session comes from the cluster; nothing in the library calls this.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session that may not have it on their path.

    Done once for each application, and only where the package lies in a folder (not when it is installed).
    """
    import os
    import shutil

    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or root.endswith("site-packages"):
        return
    folder = tempfile.mkdtemp(prefix="keyloom-package-")
    made = shutil.make_archive(os.path.join(folder, "keyloom"), "zip", root, "keyloom")
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set if the session runs on one
    machine; on a cluster that is an error, as its machines share no such folder.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, partition by partition.

    Used where a plan reads a result twice and both reads must see the same rows in the same
    partitions (range partitioning samples its input, so its bounds differ from run to run).
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the checkpoint folder: smaller than a checkpoint, and columns are read apart.

    For results that are read many times; the order of rows and partitions is not kept.
    """
    path = f"{checkpoint_root(df.sparkSession)}/keyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Remove the tables and checkpoints that this session wrote; nothing that reads them may run later.

    How many folders were removed.
    """
    context, jvm = spark.sparkContext, spark._jvm
    paths = _STORED.pop(context.applicationId, [])
    if context.getCheckpointDir() is not None:
        paths.append(context.getCheckpointDir())
    removed = 0
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if path == context.getCheckpointDir():  # the folder stays, as later checkpoints go there
            removed += sum(fs.delete(s.getPath(), True) for s in fs.listStatus(where))
        else:
            removed += fs.delete(where, True)
    return removed


def partitions(df: DataFrame, size: int = 128 << 20) -> int:
    """How many partitions to ask for: as many as are set, or more where the tables read are large.

    The sizes of the tables are added up (Catalyst's estimate of a join multiplies them). A number that is
    asked for stands; the run-time replanning does not split such partitions.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 55)  # beyond: not known
    return max(least, min(-(-known // size), 100_000))


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def bytes_at_most(df: DataFrame, limit: int) -> bool:
    """Whether the rows of ``df`` take at most ``limit`` bytes; reads no more than it must to tell.

    Numbers count 8 bytes, texts and nested values their length as text.
    """
    loose = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    fixed = 16 + 8 * len(df.columns)
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in loose]
    length = sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in quoted), F.lit(0)).cast("bigint")
    rows = limit // fixed + 1
    n, size = df.limit(rows).agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    return n < rows and n * fixed + size <= limit


def guarded_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` takes at most ``max_bytes``.

    Beyond that the frame is returned without a hint and the join shuffles (AQE splits skewed
    partitions).
    """
    return F.broadcast(df) if bytes_at_most(df, max_bytes) else df


def previous_row(
    df: DataFrame,
    group: list[str],
    time: str,
    tie: str,
    carry: list[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Add the values of ``carry`` from the row before in the group, ordered by (time, tie).

    A group may hold a third of all rows, so the order is worked out in tiles of one calendar
    month: inside a tile with ``lag``, across tiles from the last row of each tile (one row for
    each group and month).  Null times sort first and share one tile.  The added column
    ``<prefix>row`` is a struct of ``carry``; it is null for the first row of a group.
    """
    tile, last, first = fresh("tile"), fresh("last"), fresh("first")
    out = f"{prefix}row"
    tiled = df.withColumn(tile, F.coalesce(F.year(time) * 12 + F.month(time), F.lit(-1)))
    inside = Window.partitionBy(*group, tile).orderBy(F.col(time).asc_nulls_first(), F.col(tie))
    value: Column = F.struct(*[F.col(c) for c in carry])
    tiled = tiled.withColumn(out, F.lag(value).over(inside)).withColumn(first, F.row_number().over(inside) == 1)
    ends = tiled.groupBy(*group, tile).agg(
        F.max_by(value, F.struct(F.col(time).isNotNull(), F.col(time), F.col(tie))).alias(last)
    )
    across = Window.partitionBy(*group).orderBy(tile)
    before = ends.select(*group, tile, F.lag(last).over(across).alias(last))
    joined = tiled.join(before, [*group, tile], "left")
    return joined.withColumn(out, F.when(F.col(first), F.col(last)).otherwise(F.col(out))).drop(tile, last, first)
