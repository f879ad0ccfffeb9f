"""The shared folder, tables written to it, and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one local process (tests), a temporary folder takes its
    place; on a cluster a missing setting is an error, since local folders are not shared there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="partita-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        path = f"{tempfile.mkdtemp(prefix='partita-')}/partita.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


class Scratch:
    """Tables written once to the shared folder, so that later stages and lost executors reread them.

    ``write`` cuts the lineage; ``drop`` removes a table that no later plan reads.  What is left goes
    when the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/partita-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root, True)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str, at_exit: bool = False) -> None:
        sc = self.spark.sparkContext
        try:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            if not at_exit:  # at exit the JVM may be gone
                raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
