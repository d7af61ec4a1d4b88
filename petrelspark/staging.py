"""Lineage cuts that survive the loss of executors.

Every iterative operator writes its intermediate tables to the shared folder that the session names in
``spark.checkpoint.dir``.  Only where that setting is absent and the session runs in one machine (as in tests)
is a folder made here.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        made = tempfile.mkdtemp(prefix="petrelspark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own[app] = f"file://{made}"
        context.setCheckpointDir(_own[app])
    return _own[app]


_scopes: list[str] = []


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this session's tables, or those of the scope that is open."""
    return "/".join([f"{shared_dir(spark)}/petrelspark/{spark.sparkContext.applicationId}", *_scopes])


@contextmanager
def scope(spark: SparkSession):
    """Tables that are staged inside go at its end, so a result that reads them has to be written before::

        with scope(spark):
            deadlocks(explore(net)).write.parquet(path)
    """
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        try:
            remove(spark, session_dir(spark))
        finally:
            _scopes.pop()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Delete this session's tables.  Call it when every result that was read from them has been written."""
    remove(spark, session_dir(spark))


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage is then one scan.

    Spark's committer makes the write atomic per task, so retried tasks leave no duplicates.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a staged table is sent to every executor where it is joined.
FEW = 20_000


def join_by_size(spark: SparkSession) -> None:
    """From here on the session broadcasts by what a shuffle wrote, up to the limit that it had for files.

    Files say little about staged tables: nets that are alike shrink a thousandfold in Parquet, so a table of a few
    MB there may not fit into the driver."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(limit)
    if had != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", had)
        spark.conf.set(limit, "-1")


def counted(df: DataFrame, name: str = "t") -> DataFrame:
    """``stage`` for tables of short rows that are joined: those of few rows are broadcast, and no other one for the size of its files."""
    join_by_size(df.sparkSession)
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return F.broadcast(out) if seen.get["n"] <= FEW else out


def settle(df: DataFrame) -> DataFrame:
    """``counted`` for the many small tables of fixpoint loops: one job, where a checkpoint would compute the table twice."""
    return counted(df, "round")
