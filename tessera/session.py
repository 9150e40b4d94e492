"""Session helpers: building a local session and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes at which a batch of rows for Python ends, unless the session has a bound of its own.
BATCH_BYTES = 1 << 21


def local_session(cpus: str | int = "*", app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder of its own; any other master must set it, since a machine-local folder would not be shared.
    """
    folder = spark.conf.get(_CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that the driver and the executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_CHECKPOINT_KEY, folder)
    return folder


def bound_batches(spark: SparkSession) -> None:
    """Let rows go to Python in batches of about BATCH_BYTES, from now on and in the whole session.

    Else 10,000 rows go at once, up to 64 MB, and an executor holds several copies of them in each of its tasks: Arrow
    buffers outside the heap, and in the Python worker the batch, its values and the results. A row longer than the bound
    is a batch of its own. No result depends on where batches end. A bound that the session has set stays.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond files that survive the loss of any executor, and statistics that
    let the planner choose between a broadcast and a shuffle by the table's true size. It stays until it is
    given to ``unstage``, or ``clear_stages`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables. Only for tables that nothing reads any more: all that was made from them has to be
    staged itself, so that no lost task can ask for them again."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            _delete(t.sparkSession, path)


def clear_stages(spark: SparkSession) -> None:
    """Delete all staged tables of the shared folder, at the end of a job: results that read them end as well."""
    _delete(spark, f"{shared_folder(spark)}/stage")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
