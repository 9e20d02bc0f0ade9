"""Token ids in binary files: blocks transposed to byte or bit planes, each plane compressed.

A shard file: the magic, then for each block of at most ``BLOCK`` ids its planes
as zstandard frames, least significant plane first, then the documents' ids
and token counts in the same coding, then the chunk index as JSON, the index's
length (8 bytes) and the magic again.  The index names for each block the first
token, the number of ids and the place, size and checksum of every plane, so a
reader fetches any range of tokens by reading its blocks' planes alone.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, filesystem, need, new_path, write_file

MAGIC = b"QSPLANE1"
BLOCK = 1 << 15


def to_planes(ids, unit: str = "byte") -> list[bytes]:
    """The planes of unsigned 32-bit ids: 4 of bytes or 32 of bits; planes above the highest set bit are left out."""
    import numpy as np

    ids = np.ascontiguousarray(ids, dtype="<u4")
    top = int(ids.max()) if len(ids) else 0
    raw = ids.view(np.uint8).reshape(len(ids), 4)
    if unit == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((top.bit_length() + 7) // 8)]
    if unit == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(top.bit_length())]
    raise ValueError(f"unknown plane: {unit}")


def from_planes(planes: list[bytes], n: int, unit: str = "byte"):
    import numpy as np

    if unit == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for k, x in enumerate(planes):
            raw[:, k] = np.frombuffer(x, np.uint8)
        return raw.view("<u4").ravel()
    bits = np.zeros((n, 32), np.uint8)
    for k, x in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Builds one shard; memory holds the compressed planes and one block of ids."""

    def __init__(self, unit: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.unit, self.block, self.zstd = unit, block, zstandard.ZstdCompressor(level=level)
        self.out, self.at, self.chunks, self.n = [MAGIC], len(MAGIC), [], 0
        self.waiting: list = []
        self.n_waiting = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def _planes(self, ids) -> list[tuple[int, int, int]]:
        placed = []
        for plane in to_planes(ids, self.unit):
            packed = self.zstd.compress(plane)
            placed.append((self.at, len(packed), zlib.crc32(packed)))
            self.out.append(packed)
            self.at += len(packed)
        return placed

    def add(self, doc_id: int | None, ids) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        import numpy as np

        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        end = len(ids) if all_ else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            part = ids[k : min(k + self.block, end)]
            self.chunks.append({"first": self.n, "n": len(part), "planes": self._planes(part)})
            self.n += len(part)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def finish(self) -> bytes:
        import numpy as np

        self._flush(True)
        tables = {}
        for name, values in (("counts", np.array(self.counts, dtype="<u8")), ("doc_ids", np.array([x or 0 for x in self.doc_ids], dtype="<i8")), ("no_id", np.array([x is None for x in self.doc_ids], dtype="u1"))):
            packed = self.zstd.compress(values.tobytes())
            tables[name] = (self.at, len(packed), zlib.crc32(packed))
            self.out.append(packed)
            self.at += len(packed)
        index = json.dumps({"unit": self.unit, "tokens": self.n, "docs": len(self.counts), "tables": tables, "chunks": self.chunks}).encode()
        return b"".join([*self.out, index, len(index).to_bytes(8, "little"), MAGIC])


class ShardReader:
    """Random access to a shard: reads the index at once and planes as asked for."""

    def __init__(self, uri: str):
        import zstandard

        self.zstd = zstandard.ZstdDecompressor()
        found, path = filesystem(uri)
        self.file = found.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._at(size - 16 - n, n))
        self.firsts = [x["first"] for x in self.index["chunks"]]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _frame(self, offset: int, size: int, crc: int) -> bytes:
        packed = self._at(offset, size)
        if zlib.crc32(packed) != crc:
            raise ValueError("a plane's checksum does not match")
        return self.zstd.decompress(packed)

    def table(self, name: str):
        import numpy as np

        return np.frombuffer(self._frame(*self.index["tables"][name]), dtype={"counts": "<u8", "doc_ids": "<i8", "no_id": "u1"}[name])

    def chunk(self, k: int):
        x = self.index["chunks"][k]
        return from_planes([self._frame(*p) for p in x["planes"]], x["n"], self.index["unit"])

    def range(self, first: int, n: int):
        """The ids from token ``first`` on."""
        import numpy as np

        out, k, want = [], bisect_right(self.firsts, first) - 1, n
        while want > 0 and k < len(self.firsts):
            part = self.chunk(k)[first - self.firsts[k] :][:want]
            out.append(part)
            first, want, k = first + len(part), want - len(part), k + 1
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def documents(self):
        """(doc id, ids) of each document in order; memory holds a block and a document."""
        import numpy as np

        counts, names, none = self.table("counts").tolist(), self.table("doc_ids").tolist(), self.table("no_id").tolist()
        held, k = np.empty(0, "<u4"), 0
        for n, name, no in zip(counts, names, none):
            parts, got = [held], len(held)
            while got < n:
                parts.append(self.chunk(k))
                got += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield None if no else name, held[:n]
            held = held[n:]


def write_ids(df: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, shards: int | None = None, unit: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the documents and write them in ascending order of id; returns the manifest (shard, path, docs, tokens, start).

    The shards follow one another: shard k holds smaller ids than shard k+1, and
    ``start`` counts the ids in earlier shards.  A lost task writes its file anew
    under a new name and only the name it reports counts.  Null ids come first;
    a null text counts as empty; rows of one id stand together, in the order of
    their texts' hashes, and may fill more than one shard.
    """
    from .common import written

    spark = df.sparkSession
    need(df, id_col, text_col)
    path = path or new_path(spark, "token-ids")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())

    def run(reader):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder as encoder_of
        from .tokens import with_end

        encoder = encoder_of(tokenizer)
        shard, writer = TaskContext.get().partitionId(), ShardWriter(unit)
        for batch in batches(reader, "text"):
            for doc, ids in zip(batch.column("id").to_pylist(), with_end(*encoder.encode(batch.column("text")), end_id)):
                writer.add(doc, ids)
        if writer.counts:
            data, uri = writer.finish(), f"{path}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.planes"
            write_file(uri, data)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, uri, len(writer.counts), writer.n, len(data))], ["shard", "path", "docs", "tokens", "bytes"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the text's hash splits the rows of one id, or of none, among shards
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text"))
    sorted_ = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    manifest = written(sorted_.mapInArrow(run, "shard bigint, path string, docs bigint, tokens bigint, bytes bigint"), "token-manifest")
    start, at = {}, 0
    for r in sorted(manifest.select("shard", "tokens").collect()):  # one row for each shard
        start[r["shard"]] = at
        at += r["tokens"]
    starts = spark.createDataFrame(list(start.items()) or [], "shard bigint, start bigint")
    return manifest.join(F.broadcast(starts), "shard")


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the files a manifest names: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<int>)."""

    def run(reader):
        import numpy as np
        import pyarrow as pa

        for batch in reader:
            for start, uri in zip(batch.column("start").to_pylist(), batch.column("path").to_pylist()):
                out: list[tuple] = []
                for doc, ids in ShardReader(uri).documents():
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), *[ids.astype(np.int32)] * with_ids))
                    start += len(ids)
                    if len(out) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names)

    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
    shards = manifest.select("shard", "start", "path")
    n = max(1, shards.count())
    return shards.repartitionByRange(n, "shard").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
