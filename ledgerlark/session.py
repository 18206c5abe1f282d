"""Session and table loading."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str = "local[8]", app: str = "ledgerlark", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a session, so that its tasks can import it wherever they run. Once a session."""
    if getattr(spark.sparkContext, "_ledgerlark_sent", False):
        return
    here = Path(__file__).resolve().parent
    packed = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ledgerlark-')}/{here.name}", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(packed)
    spark.sparkContext._ledgerlark_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
