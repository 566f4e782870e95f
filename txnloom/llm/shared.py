"""Helpers the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from txnloom.config import new_workspace
from txnloom.sources.writers import remove_folder

# Characters that separate words; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
# Rows handed to Python code at once, so that very long texts stay few at a time.
ROWS_AT_ONCE = 256

_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The folder for tables that do not outlive the step they are written in.
_PASSING: ContextVar[str | None] = ContextVar("passing", default=None)


def ship(spark: SparkSession) -> None:
    """Give this package to executors on which it is not installed, once per session."""
    context = spark.sparkContext
    if getattr(context, "_txnloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    # The driver serves the archive to the executors for as long as it runs.
    folder = tempfile.mkdtemp(prefix="txnloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"txnloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "txnloom").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._txnloom_shipped = True


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files once it has ended.

    Else they stay until the driver happens to collect its garbage, which is
    the rarer the larger the tables are that a task exchanges.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


@contextmanager
def passing(spark: SparkSession, purpose: str) -> Iterator[None]:
    """Tables written inside, also by functions called there, are deleted when it ends.

    What is made of them must have been written by then, to a path taken before.
    """
    folder = new_workspace(spark, purpose)
    token = _PASSING.set(folder)
    try:
        yield
    finally:
        _PASSING.reset(token)
        remove_folder(spark, folder)


def written(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage in a folder every executor reaches, so a lost
    executor costs nothing that is already written, and what was shuffled for
    it is removed.  The folder belongs to the run and goes when the deployment
    empties ``spark.checkpoint.dir``, or at the end of the step that is
    ``passing``.
    """
    spark = df.sparkSession
    if path is None:
        inside = _PASSING.get()
        path = f"{inside}/{purpose}-{uuid.uuid4().hex}" if inside else new_workspace(spark, purpose)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def other_fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    """Fields of ``df`` that an output called one of ``names`` does not replace."""
    taken = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def add_from_text(
    df: DataFrame,
    source: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    rows: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Add ``fields`` computed from column ``source``, a few rows at a time.

    ``make`` runs once in each task and returns the function from an Arrow
    array to the arrays of ``fields``.  A column of ``df`` with the name of an
    output is replaced; all others pass unchanged.
    """
    kept = other_fields(df, [f.name for f in fields])
    schema = T.StructType([*kept, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                new = [c.cast(t) for c, t in zip(work(part.column(source)), types, strict=True)]
                columns = [*(part.column(n) for n in names), *new]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def hex_digest(column) -> F.Column:
    return F.sha2(column, 256)
