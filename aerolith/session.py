"""Session settings and the shared working folder."""

import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(master=None, **conf):
    """A session with the settings the engine needs; used by tests and bench."""
    builder = SparkSession.builder.appName("aerolith")
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return prepare(builder.getOrCreate())


def prepare(spark):
    """Every time in the engine is UTC, whatever the session was started with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark):
    """Folder all executors can reach: the cluster's checkpoint folder; on one machine, where none is named, the warehouse."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not context.master.startswith("local") and base.startswith(("file:", "/")):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def scratch(spark, name):
    """A fresh path below the shared folder; nothing is ever cleared or reused."""
    return f"{shared_dir(spark).rstrip('/')}/aerolith/{name}-{uuid.uuid4().hex}"


def store(df, name):
    """Write a table to the shared folder and read it back: cuts lineage, survives
    lost executors, and lets several branches reuse one result."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
