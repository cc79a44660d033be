"""Small helpers that several operators share."""

from __future__ import annotations

import os
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most.
ARROW_ROWS = 1000
#: Keys that may be broadcast to pick rows; beyond that they are joined.
BROADCAST_KEYS = 200_000
#: Working columns begin with this, so that columns of the caller never clash with them.
OWN = "_sl_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is unset a session on one machine gets a temporary folder; a cluster gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession)}/strandloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sl_path = path
    for tables in _SCRATCH.get():
        tables.append(out)
    return out


#: The tables of the ``scratch`` blocks that are open.
_SCRATCH: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside are deleted at the end, so what is made of them must be written after it, or be ``kept``."""
    tables: list[DataFrame] = []
    token = _SCRATCH.set((*_SCRATCH.get(), tables))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        discard(*(t for t in tables if not getattr(t, "_sl_kept", False)))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table that outlives the ``scratch`` block."""
    out = written(df, name)
    out._sl_kept = True
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, when the tables made from them are written themselves."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._sl_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def picked(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``df`` with (or, ``left_anti``, without) the rows whose columns are in ``keys``, a written table.

    Keys are counted first: few go to every task, so that ``df`` stays where it is.
    """
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, keys.columns, how)


def bounded_rows(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, text and more), or where there are more than ``most`` the distinct ones with the smallest hashes.

    Ids may repeat in any number, so a bound on ids is none on rows.  Counting reads the ids only.
    """
    if rows.count() <= most:
        return rows
    keyed = rows.withColumn("_sl_hash", F.xxhash64("doc_id", "text"))
    cut = keyed.select("_sl_hash").distinct().orderBy("_sl_hash").limit(most).agg(F.max("_sl_hash")).first()[0]
    return keyed.filter(F.col("_sl_hash") <= cut).dropDuplicates(["_sl_hash"]).drop("_sl_hash")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the fast built-in, others ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids have no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, after telling Python workers where this package lies, and Spark to send small batches.

    The first serves sessions on one machine; on a cluster ship the package with ``--py-files``.
    Texts can be long, so the session's limit of rows in an Arrow batch is lowered where it is higher.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= ARROW_ROWS:
        df.sparkSession.conf.set(rows, str(ARROW_ROWS))
    place = str(Path(__file__).resolve().parents[2])
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if place not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([place, *filter(None, paths)])
    return df


def smaller(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches in pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
