"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="partigrid-py-"), "partigrid.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def _set_shared(sc) -> None:
    if sc.getCheckpointDir() is None:
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="partigrid-"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the folder that all executors share."""
    _set_shared(df.sparkSession.sparkContext)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    _set_shared(spark.sparkContext)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a dense number from 0 in its order, without bringing the rows together: a count for each partition gives
    where its numbers begin."""
    held = materialise(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33).cast("int")
    before, begins = 0, []
    for r in sorted(held.groupBy(part.alias("part")).count().collect()):  # a row for each partition
        begins.append((r[0], before))
        before += r[1]
    known = df.sparkSession.createDataFrame(begins, "_part int, _begin long")
    rows = held.withColumn("_part", part).join(F.broadcast(known), "_part")
    return rows.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_begin")
