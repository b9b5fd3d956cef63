"""The package sent to the Python workers of a session, which may start in any folder, and the size of the batches they get."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Rows are texts and sets of any length: batches are bounded by bytes, or 10,000 rows of kilobytes stand in the executor and the worker at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Once per application. The archive is made on the driver; Spark's own file service takes it to the executors. A size of batches that the
    session has of its own stays."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="rdspark-")) / "rdspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
