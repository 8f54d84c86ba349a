"""Session defaults, and getting the package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the engine expects of a session; all can be overridden.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
#: Spark's own default of the last: where it still holds, ship() sets ours, as two workers and their JVM hold several batches at a time.
_LARGE_BATCH = ("67108864b", "64m", "64MB", "67108864")


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults."""
    builder = SparkSession.builder.appName("lodestone")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in _LARGE_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULTS["spark.sql.execution.arrow.maxBytesPerBatch"])
    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
    context._lodestone_shipped = True
