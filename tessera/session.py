"""Session settings that every operator assumes: UTC dates, ANSI arithmetic, adaptive plans."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; later keywords (dots as double underscores) override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long: hand them to Python workers in batches of so many rows, unless the session has a limit of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark context; for sessions that were not submitted with it."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    context.addPyFile(path)
    context._tessera_shipped = True
