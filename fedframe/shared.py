"""The folder that the driver and all executors share, and whether they are one process."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import ConfigError

#: Temporary folders by application: Spark's setting can't be changed once it runs.
_made: dict[str, str] = {}


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver."""
    return spark.sparkContext.master.startswith(("local[", "local ")) or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not one_process(spark):
            raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _made.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="fedframe-")
        _made[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def mounted_dir(spark: SparkSession) -> str:
    """shared_dir as a path that open() takes; an error where it is in a store that only Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        raise ConfigError(f"{path} is not mounted: spark.checkpoint.dir must be a folder that every host mounts")
    return path.toUri().getPath()
