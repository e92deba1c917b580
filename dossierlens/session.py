"""Session settings that the jobs are written for."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# The wide projections of extraction and validation exceed the size up to which the JVM compiles one method. With this
# limit Spark falls back to many small generated methods for such operators instead of one that is only interpreted.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# What Spark takes where nobody sets it, for the setting above that a running session can still be given.
HUGE_METHOD_LIMIT, SPARK_HUGE_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit", "65535"


def adapt(spark: SparkSession) -> None:
    """Give a session that was built without ``configure`` the limit on generated methods; one that was set otherwise stays."""
    if spark.conf.get(HUGE_METHOD_LIMIT) == SPARK_HUGE_METHOD_LIMIT:
        spark.conf.set(HUGE_METHOD_LIMIT, SETTINGS[HUGE_METHOD_LIMIT])


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


_shipped = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application. The driver may have found it through a path that executors do
    not have; Spark serves the archive to them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "dossierlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
