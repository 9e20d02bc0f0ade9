"""Concatenate and cut: documents' tokens in one stream, cut into sequences of fixed length.

Pass one encodes the documents and writes, for each, its ids and the number of
ids before it in its task.  The totals of the tasks, one number each, are
summed up to the global offset of every task.  Pass two knows with that where
each document begins in the stream, so it cuts every document by itself at the
windows' bounds: a document that crosses a bound leaves one boundary record on
either side.  No row moves to another task.  Only the last sequence is short.

Defined results: a null text counts as empty and holds the end id alone;
repeated rows are packed again; an empty table gives no pieces; a null id stays
null.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, need, written

LENGTH, END_ID = 2048, 1


def tokenised(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(task, before, id, ids): each document's ids with the end id, as little-endian unsigned 32-bit integers or 16-bit if all fit."""

    def run(reader):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder as encoder_of
        from .tokens import with_end

        encoder, task, before = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches(reader, "text"):
            ids, counts = encoder.encode(batch.column("text"))
            counts = counts + 1
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            ids = [_narrow(x) for x in with_end(ids, counts - 1, end_id)]
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["task", "before", "id", "n", "ids"])

    need(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"task int, before bigint, id {kind}, n bigint, ids binary")


def _narrow(ids) -> bytes:
    """A byte that says how wide the ids are, then the ids."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def _wide(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, dtype="<u2" if raw[0] == 2 else "<u4", offset=1).astype("<u4")


def task_offsets(table: DataFrame) -> dict[int, int]:
    """The global offset of each task: one number for each of the tasks that wrote the table."""
    totals = sorted((r["task"], r["n"]) for r in table.groupBy("task").agg(F.sum("n").alias("n")).collect())
    out, at = {}, 0
    for task, n in totals:
        out[task] = at
        at += n
    return out


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, if asked for, ids (array<int>).

    ``start`` counts the document's own ids before the piece, ``offset`` those
    before it in its sequence.  A sequence's pieces sorted by offset are its
    tokens; a consumer pads the last sequence to ``length`` unless its length is
    a power of two.
    """
    table = written(tokenised(df, tokenizer, end_id, id_col, text_col), "packing-ids")
    base = df.sparkSession.sparkContext.broadcast(task_offsets(table))  # a number for each task

    def cut(reader):
        import numpy as np
        import pyarrow as pa

        offsets = base.value
        for batch in batches(reader, "ids"):
            rows: list[tuple] = []
            pieces, own = [], []
            for k, (task, before, raw) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("task", "before", "ids")))):
                ids = _wide(raw)
                at, n = offsets[task] + before, len(ids)
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[start : start + size]
                    rows.append((start, size, zlib.crc32(piece.tobytes()), n, sequence, offset))
                    own.append(k)
                    if with_ids:
                        pieces.append(piece.astype(np.int32))
                    start += size
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 6)]
            columns = [batch.column("id").take(pa.array(own, pa.int64())), *columns]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kind = table.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{x} bigint" for x in names[1:7]) + ", ids array<int>" * with_ids
    return table.select("task", "before", "id", "ids").mapInArrow(cut, schema).withColumnRenamed("id", id_col)
