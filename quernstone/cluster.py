"""Getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to all executors of a session, once; their own folders need not have it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "quernstone-source.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """A URI below the folder that the cluster names in ``spark.checkpoint.dir``.

    A session on one machine may name none and gets one of its own there; any
    other has to, as executors do not see each other's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/{os.environ.get('USER', 'user')}-{os.getpid()}"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/quernstone"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, tables: list | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and lost executors cost no rework.

    With ``tables`` it is noted there, for ``drop_tables`` once nothing reads it any more.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if tables is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
