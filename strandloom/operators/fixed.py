"""Columns and tables that are computed once, and Python workers that find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns``, but what follows refers to the values and not to their definitions.

    The optimiser writes definitions into later conditions and projections; over many steps that
    multiplies long expressions.  It does not look through a generator, and one over an array of
    one struct costs next to nothing.  The array is a column of its own, as a generator that holds a lambda
    would have all its expressions interpreted row by row, and a projection compiles all but the lambda.
    ``inline_outer`` as the optimiser puts a filter on the array's size, with all definitions, before ``inline``.
    """
    kept = [c for c in df.columns if c not in columns]
    values = F.array(F.struct(*(c.alias(n) for n, c in columns.items())))
    return df.select(*kept, values.alias("_fixed")).select(*kept, F.inline_outer("_fixed"))


def _shared(df: DataFrame) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir``.

    Where it is unset a session on one machine gets a temporary folder; a cluster gets an error, as its machines share none.
    """
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` as rows in the session's checkpoint folder, for tables that several plans read again."""
    _shared(df)
    return df.checkpoint()


def in_columns(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``materialised``, but as Parquet: plans that need few columns or few rows read no others.

    Columns are written under their numbers, as Parquet has no two names that differ in case only; types that
    it has not (void, intervals) are written as rows.
    """
    if any(x in f.dataType.simpleString() for f in df.schema for x in ("void", "interval", "variant")):
        return materialised(df)
    path = f"{_shared(df)}/columns-{uuid.uuid4().hex}"
    numbers = [f"_{i}" for i in range(len(df.columns))]
    plain = df.toDF(*numbers)
    plain.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._written = True
    return out


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table as ``in_columns`` gave it, which need not be written once more."""
    return getattr(df, "_written", False)


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, after telling Python workers of a session on one machine where this package lies.

    On a cluster ship the package with ``--py-files``.
    """
    environment = df.sparkSession.sparkContext.environment
    place, paths = str(Path(__file__).resolve().parents[2]), environment.get("PYTHONPATH", "").split(os.pathsep)
    if place not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([place, *filter(None, paths)])
    return df
