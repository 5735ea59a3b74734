"""SparkSession construction with the settings the library is designed for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

PARENT = str(Path(__file__).resolve().parents[1])


def build_session(app: str = "medlar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI casts, adaptive execution and Arrow transfer.

    ``conf`` overrides any setting; underscores in its names stand for dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package wherever the driver was started; elsewhere it is installed or
    shipped with --py-files."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PARENT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([PARENT, *filter(None, paths)])
