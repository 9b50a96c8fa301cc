"""What every job needs from its session: code on the executors, and a shared folder for tables that cut lineage."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
#: Rows go to Python in Arrow batches of about this many bytes. Both sides hold a batch several times over while it is made and sent.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2_000_000
_shipped: set[str] = set()
_run: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of `spark`, once per application, and bound the session's Arrow batches.

    The bound of Spark's own, 64 MB, would hold for each task of an executor. A session that sets one keeps it.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="dimstar_code_")) / "dimstar_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset and the master local (tests), one of our own.

    A cluster without one raises ValueError, as the executors don't see the driver's own folders.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dimstar_shared_"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables that operators write for themselves inside go to a folder of this run, which is removed at the end.

    Results are read from such tables, so what is wanted of them has to be written, or brought to the driver, before the end:

        with run_folder(spark):
            operator(df).write.parquet(path)
    """
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    Within `run_folder` the table goes with the run; else it stays for the folder's owner to clear.
    """
    spark = df.sparkSession
    path = f"{_run.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
