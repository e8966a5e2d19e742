"""Helpers that several operators need: lineage cuts, current rows, transcript ids."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once an application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(_own_folder()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder() -> str:
    """A folder of this machine that is removed at the end."""
    folder = tempfile.mkdtemp(prefix="nucleoframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: that of the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves in local mode only; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = _own_folder()
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """A new place for written tables in the shared folder."""
    return f"{_shared_folder(spark)}/{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def latest_rows(df: DataFrame, keys: list[str], version: str, keep: list[str]) -> DataFrame:
    """One row per key: that with the latest ``version``, reduced to ``keep``.

    Only the kept columns are shuffled, and partial aggregation drops older rows
    before that, so a key with many deliveries is no hot spot.  Rows whose first key
    is null are dropped; a null version is older than any other; among rows
    of equal version the greatest kept values win, so the result is the same on every run.
    """
    rows = df.where(F.col(f"`{keys[0]}`").isNotNull()).select(
        *[F.col(f"`{k}`").alias(k) for k in keys],
        F.struct(F.col(f"`{version}`").alias("_v"), *[F.col(f"`{c}`").alias(c) for c in keep]).alias("_row"),
    )
    best = rows.groupBy(*keys).agg(F.max("_row").alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in keep])


def bare_id(c: Column) -> Column:
    """A transcript id without outer blanks, prefix up to ``:`` and version, in upper case."""
    return F.upper(F.regexp_replace(c, r"^\s*(?:.*:)?\s*|\s*$|\.\d+\s*$", ""))
