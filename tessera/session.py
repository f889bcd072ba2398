"""Sessions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: UTC dates, adaptive plans with skew handling; sizes of partitions are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Applications whose workers have the package.
_shipped: set[str] = set()


def app_id(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def ship(spark: SparkSession) -> None:
    """Give the package to workers that do not have it: a ZIP file of its modules, sent by the driver."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tessera-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tessera", "zip", os.path.dirname(root), os.path.basename(root)))


def session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if app_id(spark) not in _shipped:
        _shipped.add(app_id(spark))
        ship(spark)
    return spark
