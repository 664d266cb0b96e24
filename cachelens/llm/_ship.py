"""The package on the executors, where it is not installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Texts differ in length by orders of magnitude, so batches that go to Python workers are bounded by bytes.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application, and bounds batches where the session does not."""
    sc = spark.sparkContext
    for key, value in BATCH_BYTES.items():
        if spark._jsparkSession.sessionState().conf().getAllConfs().get(key).isEmpty():
            spark.conf.set(key, value)
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="cachelens-")) / "cachelens_modules.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
