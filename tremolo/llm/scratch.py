"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it back, so a lost
executor never costs more than the step that is running.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_OPEN: list["Scratch"] = []
#: Of the Python workers: what is freed above these sizes goes back to the system.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tremolo-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(df: DataFrame, name: str, *more: str) -> str:
    """A column name like ``name`` that neither ``df`` has, whatever the case of its letters, nor ``more``."""
    taken = {c.lower() for c in (*df.columns, *more)}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    """What a Python worker makes once and keeps for its later tasks; the one before it goes.

    Tasks must call this function of a module: a dictionary that a nested function names is copied into every task.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


class Scratch:
    """Tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tremolo-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        # Python gets batches bounded by bytes and by rows, so long texts can't fill a worker.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
        # Python workers import this package from where the driver has it (a cluster may install it instead),
        # and give freed memory back: idle workers of earlier steps stay alive beside those that work.
        home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        for k, v in WORKER_MEMORY.items():
            env.setdefault(k, v)
        if home not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(filter(None, [home, env.get("PYTHONPATH", "")]))
        _OPEN.append(self)

    def table(self, df: DataFrame, free: bool = False) -> DataFrame:
        """Write ``df``, read it back; ``free`` lets Spark delete the shuffle files of what is done."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        if free:
            del df
            self.free()
        return back

    def free(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        self._delete(self.root)


@atexit.register
def _close_all() -> None:
    for s in _OPEN:
        try:
            s.close()
        except Exception:  # the session may be gone; its folder goes with the job
            pass
    _OPEN.clear()
