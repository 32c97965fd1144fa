"""Session helpers shared by the library's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor directory; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks (clusters bring their own)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framewright")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
