"""What the operators share: written tables, files beside them, plain checks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import new_path, shared_folder, written

#: The white space that separates words, as a regular expression of its complement.
WORD = r"[^\x20\x09-\x0D]+"


def drop_tables(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables noted by ``written``; the list is empty afterwards."""
    while tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path in it; works on driver and executors alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "/", 1)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a file whole: under another name first, so a lost task leaves no half file behind."""
    found, path = filesystem(uri)
    found.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with found.open_output_stream(part) as out:
        out.write(data)
    found.move(part, path)


def read_file(uri: str) -> bytes:
    found, path = filesystem(uri)
    with found.open_input_stream(path) as f:
        return f.read()


def map_file(uri: str, dtype):
    """A file's numbers, mapped into memory; a file of another store is fetched to memory."""
    import numpy as np

    found, path = filesystem(uri)
    if uri.startswith("file:"):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    return np.frombuffer(read_file(uri), dtype=dtype)


def need(df: DataFrame, *columns: str) -> None:
    missing = [x for x in columns if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def batches(reader, text: str, limit: int = 2_000_000, rows: int = 1 << 30):
    """Cut Arrow record batches into slices of at most ``rows`` rows whose texts hold about ``limit`` bytes; one text stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in reader:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        part = np.concatenate([[0], np.cumsum(size)[:-1]]) // limit if len(size) else size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)] if len(size) else []
        for a, b in zip(cuts, cuts[1:]):
            for k in range(a, b, rows):
                yield batch.slice(k, min(b - k, rows))


__all__ = ["WORD", "batches", "docs", "drop_tables", "filesystem", "fresh", "map_file", "need", "new_path", "read_file", "shared_folder", "text_or_empty", "write_file", "written"]
