"""Session settings and the shared scratch area.

Intermediate tables that are read more than once are written, as Parquet, to
the folder named by ``spark.checkpoint.dir``. Unlike a cached or locally
checkpointed frame, such a table survives the loss of any executor, cuts the
lineage, and tells the optimizer its real size. A session that names no such
folder uses one below its warehouse, which is shared as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
WAREHOUSE_KEY = "spark.sql.warehouse.dir"

# Scratch tables of each application, in the order of writing.
_written: dict[str, list[str]] = {}


def build_session(
    master: str = "local[*]", app_name: str = "topicloom", **conf: str
) -> SparkSession:
    """A session with the settings the operators are designed around."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    return (named or f"{spark.conf.get(WAREHOUSE_KEY)}/scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the scratch tables this application has written and not released."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Iterable[str] | None = None) -> None:
    """Delete scratch tables this application wrote: all of them, or those given."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in list(own if paths is None else paths):
        if path in own:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            own.remove(path)
