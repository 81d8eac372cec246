"""Reading the input tables, giving executors the package, and names of columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoint import materialise  # noqa: F401  (the operators take it from here)

#: Bytes of an Arrow batch.
ARROW_BYTES = 8 << 20
#: Words of the contracts: runs of anything but ASCII white space.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: functions that run there import it. Arrow batches are held small, as
    a batch of texts is in memory several times, in the JVM and in Python."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if any(Path(x).name == "flowgraph.zip" for x in context._python_includes):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="flowgraph-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, "flowgraph.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder; the path may be in any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unique_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever extra columns it carries (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own(df: DataFrame) -> list[F.Column]:
    """df's columns, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def without(df: DataFrame, names: Iterable[str], needed: str) -> DataFrame:
    """df without extra columns of these names (in any case), so that results can take them; `needed` must not be one."""
    taken = {n.lower() for n in names}
    if needed.lower() in taken:
        raise ValueError(f"a result can't have the name of its input {needed}; choose another name")
    return df.select([c for c, name in zip(own(df), df.columns) if name.lower() not in taken])


def size_in_words(text) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
