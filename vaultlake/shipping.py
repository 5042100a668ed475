"""Makes this package importable in Python workers wherever the session runs, and bounds what they are given at once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: An Arrow batch takes no further row beyond this many bytes.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession, rows: int = 10_000) -> None:
    """Before Arrow functions: bound what one batch of whole texts or objects can hold in a worker, and send it this package.

    A batch closes at `rows` rows or BATCH_BYTES, whichever comes first; a longer text has a batch of its own. What the
    session has set itself stays.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session. `small_batches` calls this."""
    context = spark.sparkContext
    if getattr(context, "_vaultlake_shipped", False):
        return
    root, out = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="vaultlake-code-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    with zipfile.ZipFile(path := f"{out}/vaultlake.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._vaultlake_shipped = True
