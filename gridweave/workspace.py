"""Intermediate tables that outlive executors.

Iterative operators cut their lineage by writing a table to the folder the
cluster names in ``spark.checkpoint.dir`` and reading it back, so a lost
executor never costs more than the step it was running.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.split("-cluster")[0].startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/gridweave-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_gridweave_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "gridweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    context._gridweave_shipped = True


class Workspace:
    """A folder of its own for one operator's intermediate tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/ws-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []
        self._tables: list[str] = []
        ship(spark)

    def own_table(self, name: str) -> str:
        """The folder for a table of the catalog, which is dropped with the others."""
        self._tables.append(name)
        self._paths.append(f"{self.root}/{name}")
        return self._paths[-1]

    def adopt(self, df: DataFrame) -> DataFrame:
        """Own what another workspace saved, or save ``df`` if it isn't a table as saved."""
        path = getattr(df, "_workspace_path", None)
        if path is None:
            return self.save(df)
        self._paths.append(path)
        return df

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        self._paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            self._delete(getattr(df, "_workspace_path", None))

    def _delete(self, path: str | None) -> None:
        if path in self._paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self._paths.remove(path)

    def clear(self) -> None:
        """Delete all tables saved here."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
        for path in list(self._paths):
            self._delete(path)
        self.release()

    def release(self) -> None:
        """Let go of tables that nothing refers to; Spark then deletes their shuffle files."""
        gc.collect()
        self.spark._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        """Save a result and delete all that was saved here before, which ``df`` may read."""
        before, self._paths = self._paths, []
        out = self.save(df)
        kept, self._paths = self._paths, before
        self.clear()
        self._paths = kept
        return out
