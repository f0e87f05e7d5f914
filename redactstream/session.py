"""Session settings the jobs rely on; a cluster's own settings always win."""

from __future__ import annotations

import re
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import redactstream

REQUIRED = {
    # Timestamps in the audit trail are UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles a method of more bytecode than this; a generated one that is larger would
    # be interpreted for every row, while a plan step by step runs compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Detection builds large expressions; tracing the Python line of each part of them
    # would take longer than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every job needs to a session somebody else built."""
    # The few functions that run in Python workers travel with the job, so executors do
    # not need the package installed.
    cloudpickle.register_pickle_by_value(redactstream)
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage; a local one only if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def local_session(cores: str = "*", app: str = "redactstream", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        **REQUIRED,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
