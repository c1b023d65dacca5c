"""Makes this package importable for Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tidemark

BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once a Spark context, and bounds Arrow batches by size.

    A batch of ten thousand rows, Spark's default, may be gigabytes of long texts; a bound in bytes holds for any length. A session
    that has set a bound of its own keeps it.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "tidemark_shipped", False):
        return
    top = Path(tidemark.__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(out))
    context.tidemark_shipped = True
