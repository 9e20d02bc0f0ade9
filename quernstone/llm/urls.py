"""URL rules looked up in a sorted digest array.

The rules' strings (host and path) become 64-bit xxhash keys in one sorted
array, with the strings beside it.  The array lies in three files of the shared
folder: keys, string offsets, string bytes.  A worker maps them into memory,
hashes every key that a url's host and path can match, finds them by vectorised
binary search, and confirms each hit against the stored string, so a collision
of hashes never counts.

Among a url's matching rules the longest string wins, among equals the one with
the longer host.  Without a rule the verdict is the list's default.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule; repeated rows each get their result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, map_file, need, new_path, write_file

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"


class DigestArray:
    """Rules as sorted keys with their strings; ``find`` looks up many strings at once."""

    def __init__(self, keys, offsets, raw, blocked):
        self.keys, self.offsets, self.raw, self.blocked = keys, offsets, raw, blocked

    @staticmethod
    def build(spark: SparkSession, rules: Iterable[tuple[str, str, str]], path: str | None = None) -> dict:
        """Write the files and return what a worker needs to open them: paths and the shapes of the rules."""
        import numpy as np
        import xxhash

        entries: dict[str, str] = {}
        depths, lengths = set(), set()
        for verdict, host, start in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict: {verdict}")
            entries[f"{host}{start}"] = verdict
            depths.add(host.count(".") + 1)
            lengths.add(len(start))
        found = sorted((xxhash.xxh64_intdigest(x), x) for x in entries)
        strings = [x.encode() for _, x in found]
        path = path or new_path(spark, "url-rules")
        write_file(f"{path}/keys.u64", np.array([k for k, _ in found], dtype="<u8").tobytes())
        write_file(f"{path}/offsets.u64", np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype("<u8").tobytes())
        write_file(f"{path}/strings.bin", b"".join(strings))
        write_file(f"{path}/blocked.u8", np.array([entries[x] == "block" for _, x in found], dtype="u1").tobytes())
        return {"path": path, "depths": sorted(depths), "lengths": sorted(lengths)}

    @classmethod
    def open(cls, path: str) -> DigestArray:
        return cls(*(map_file(f"{path}/{name}", kind) for name, kind in (("keys.u64", "<u8"), ("offsets.u64", "<u8"), ("strings.bin", "u1"), ("blocked.u8", "u1"))))

    def string(self, k: int) -> bytes:
        return self.raw[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()

    def find(self, asked: list[str]):
        """The place of each string in the array, or -1."""
        import numpy as np
        import xxhash

        keys = np.fromiter((xxhash.xxh64_intdigest(x) for x in asked), dtype=np.uint64, count=len(asked))
        out = np.full(len(asked), -1, dtype=np.int64)
        at = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for k in hits:
            place, want = int(at[k]), asked[k].encode()
            while place < len(self.keys) and self.keys[place] == keys[k]:  # strings that collide stand side by side
                if self.string(place) == want:
                    out[k] = place
                    break
                place += 1
        return out


def host_and_path(url):
    """Columns for the host and the path of a url."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: id, host, path, rule, verdict."""
    need(df, id_col, url_col)
    spec = DigestArray.build(df.sparkSession, rules)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def run(reader):
        import pyarrow as pa

        found = DigestArray.open(spec["path"])
        for batch in batches(reader, "path"):
            asked: list[str] = []
            owner: list[int] = []
            for k, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                labels = h.split(".") if h else []
                suffixes = [".".join(labels[-d:]) for d in spec["depths"] if d <= len(labels)]
                for suffix in suffixes:
                    for n in spec["lengths"]:
                        if n <= len(p):
                            asked.append(suffix + p[:n])
                            owner.append(k)
            best: dict[int, tuple[int, int]] = {}
            for k, text, place in zip(owner, asked, found.find(asked).tolist()):
                if place >= 0 and (k not in best or len(text) >= best[k][0]):
                    best[k] = (len(text), place)
            rule = [found.string(best[k][1]).decode() if k in best else None for k in range(len(batch))]
            verdict = [("block" if found.blocked[best[k][1]] else "allow") if k in best else default for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


#: What op8 returns, for DuckDB.
ORACLE_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
    SELECT page_id, host, path,
        (SELECT arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) FROM rules
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS hit
    FROM parts
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM best
"""
