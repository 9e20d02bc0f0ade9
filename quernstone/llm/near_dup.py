"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set: its word shingles, each with the number of times
it occurs.  Two documents are alike by the weighted Jaccard similarity, the sum
of the smaller weights over that of the larger ones.

1. One pass over the texts gives every document the digest of its weighted set,
   its signature and its band keys.  Documents with equal sets are one node from
   here on, so exact copies never meet each other in a join.
2. Nodes that share a band key form a bucket.  Each bucket names as its centre
   the member that shares most buckets; only (centre, member) pairs leave the
   join, so rows grow with the members and not with their pairs.
3. A centre's group is dealt out in blocks of bounded size.  Inside a block
   signatures point out promising pairs (those that agree on a share of
   coordinates at most ``MARGIN`` below the threshold), which are compared
   exactly unless their nodes are linked already; only a spanning forest leaves
   the task.
   Members of larger groups that their own centre does not reach are compared
   with all other blocks as well, so no link between two buckets' nodes is lost.
4. Links join to classes by alternating minima over neighbours, in tables.

Defined results: a null text counts as empty; texts without a word form one
class; a text of fewer than five words has one shingle of all its words;
repeated rows stay, each in its text's class; an empty table gives no rows; a
null id is allowed, and a class is named by its smallest id that is not null.
Ids that repeat or are null can name several classes alike: ``class_key`` tells
them apart.  The row that stays of a class is that of the smallest id, then of
the smallest digest of id and text, so each class keeps one row whatever its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_tables, fresh, need, text_or_empty, written
from .secrets import row_key

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
#: Most members of a centre's group that one task holds at a time.
BLOCK = 512
#: Signatures whose share of equal coordinates is lower by so much are not compared exactly: about 4.5 standard deviations.
MARGIN = 0.14


#: Most texts whose signatures a task draws at a time: each takes over a thousand darts, however short it is.
TEXTS_AT_ONCE = 512


def _sets(batch, text: str, words: int):
    """Each text's distinct shingles in order, and how often each occurs."""
    import numpy as np

    from .hashing import shingles
    from .hashing import words as hashed

    found, counts = hashed(batch.column(text))
    return [np.unique(x, return_counts=True) for x in shingles(found, counts, words)]


def _signatures(sets, k: int):
    import numpy as np

    from .dart_minhash import signatures

    return signatures(np.concatenate([x for x, _ in sets]), np.array([len(x) for x, _ in sets], dtype=np.int64), np.concatenate([w for _, w in sets]).astype(np.float64), k)


def _bytes(weighted) -> bytes:
    """A weighted set as bytes: the number of elements, the elements, and their weights unless all are 1."""
    import numpy as np

    elements, weights = weighted
    return np.uint64(len(elements)).tobytes() + elements.tobytes() + (weights.astype("<u4").tobytes() if (weights > 1).any() else b"")


def _weighted(raw: bytes):
    import numpy as np

    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    elements = np.frombuffer(raw, np.uint64, n, 8)
    return elements, np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64) if len(raw) > 8 + 8 * n else np.ones(n, np.int64)


def _node(weighted) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(_bytes(weighted))


def _same(a, b) -> int:
    """The sum of the smaller weights of two sets."""
    import numpy as np

    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    return int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS, with_key: bool = False) -> DataFrame:
    """(id, node, n_shingles, bands): the digest of each text's shingle set, and a key for each band; also ``key``, a digest of id and text."""
    extra = ["key"] * with_key

    def run(reader):
        import numpy as np
        import pyarrow as pa

        from .dart_minhash import band_keys

        for batch in batches(reader, "text", 500_000, TEXTS_AT_ONCE):
            if not len(batch):
                continue
            sets = _sets(batch, "text", words)
            counts = np.array([len(x) for x, _ in sets], dtype=np.int64)
            keys = band_keys(_signatures(sets, bands * rows), rows).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([_node(x) for x in sets], pa.binary()), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].ravel())), *(batch.column(x) for x in extra)],
                ["id", "node", "n_shingles", "bands", *extra],
            )

    need(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    key = [row_key(F.col(id_col), text=text_or_empty(text_col)).alias(x) for x in extra]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *key).mapInArrow(run, f"id {kind}, node binary, n_shingles int, bands array<bigint>" + ", key string" * with_key)


def _links_in(ids, sets, signature, threshold: float, far: list[int], near: int):
    """Spanning links among nodes: pairs of which one at least is in ``far``; compared exactly unless joined already.

    ``near``: the nodes before this position are compared with those of ``far`` only.
    """
    import numpy as np

    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([int(w.sum()) for _, w in sets])
    a, b, alike = [], [], []
    for i in far:
        js = np.arange(near or i)
        if not len(js):
            continue
        share = (signature[js] == signature[i]).mean(axis=1)
        ok = (share >= threshold - MARGIN) & (np.minimum(sizes[js], sizes[i]) >= threshold * np.maximum(sizes[js], sizes[i]))
        js = js[ok]
        a += [i] * len(js)
        b += js.tolist()
        alike.append(share[ok])
    links = []
    for p in np.argsort(-np.concatenate(alike), kind="stable").tolist() if alike else []:
        i, j = a[p], b[p]
        if (x := root(i)) == (y := root(j)):
            continue
        same = _same(sets[i], sets[j])
        if same >= threshold * (sizes[i] + sizes[j] - same):
            parent[x] = y
            links.append((ids[i], ids[j]))
    return links, root


def _blocks(threshold: float, cross: bool):
    """Work on rows sorted by (centre, block, chunk): one list of links for each, and the far members of split groups."""

    def one(rows):
        import numpy as np

        ids, sets, signature, roles, split = [], [], [], [], rows[0]["n_blocks"] > 1
        for r in sorted(rows, key=lambda r: r["role"]):
            ids.append(r["node"])
            sets.append(_weighted(r["shingles"]))
            signature.append(np.frombuffer(r["signature"], dtype=np.uint8))
            roles.append(r["role"])
        signature = np.stack(signature)
        near = roles.index(1) if cross and 1 in roles else len(ids) if cross else 0
        links, root = _links_in(ids, sets, signature, threshold, list(range(near, len(ids))), near)
        out = [(x, y, False) for x, y in links]
        if split and not cross:
            centre = rows[0]["centre"]
            home = root(ids.index(centre)) if centre in ids else -1
            out += [(centre, x, True) for k, x in enumerate(ids) if root(k) != home]
        return out

    def run(reader):
        import pyarrow as pa

        def flush(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.bool_()))], ["a", "b", "far"])

        key, rows, found = None, [], []
        for batch in reader:
            for k in range(0, len(batch), 128):
                for r in batch.slice(k, 128).to_pylist():
                    if (now := (r["centre"], r["block"], r["chunk"])) != key:
                        if len(rows) > 1:
                            found += one(rows)
                        key, rows = now, []
                    rows.append(r)
            if found:
                yield flush(found)
                found = []
        if len(rows) > 1:
            found += one(rows)
        if found:
            yield flush(found)

    return run


def links(df: DataFrame, sketch: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, tables: list | None = None) -> DataFrame:
    """(a, b): links between nodes, enough of them to join all nodes that verified links join; ``tables`` notes what it writes."""
    # one id for each node: its text is read again only if the node shares a bucket
    nodes = written(sketch.where("n_shingles > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.min("id").alias("id")), "near-dup-nodes", tables)
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # counts by key are written before they are joined back, and merged at every size: a join of two scans lets a hot key be split
    full = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-dup-keys", tables)
    shared = written(keyed.join(full.hint("merge"), "key"), "near-dup-buckets", tables)
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    centres = written(shared.join(score.hint("merge"), "node").groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("centre")), "near-dup-centres", tables)
    pairs = written(shared.join(centres.hint("merge"), "key").select("centre", "node").distinct(), "near-dup-pairs", tables)

    def read_sets(reader):
        import numpy as np
        import pyarrow as pa

        for batch in batches(reader, "text", 500_000, TEXTS_AT_ONCE):
            if not len(batch):
                continue
            sets = _sets(batch, "text", words)
            signature = (_signatures(sets, bands * rows) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.binary()), pa.array([_bytes(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in signature], pa.binary())], ["node", "shingles", "signature"])

    wanted = nodes.select("node", "id").join(pairs.select("node").distinct(), "node", "left_semi").select(F.col("id").alias("wanted")).distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = texts.mapInArrow(read_sets, "node binary, shingles binary, signature binary").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("signature").alias("signature"))
    sets = written(sets, "near-dup-sets", tables)

    groups = written(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("n_blocks")), "near-dup-groups", tables)
    placed = written(pairs.join(groups.hint("merge"), "centre").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_blocks")).cast("int")), "near-dup-blocks", tables)
    # the centre goes to every block of its group
    everywhere = groups.where("n_blocks > 1").select("centre", F.col("centre").alias("node"), "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    first = placed.select("centre", "node", "n_blocks", "block").unionByName(everywhere).distinct().withColumns({"chunk": F.lit(0), "role": F.lit(0)})
    schema = "a binary, b binary, far boolean"

    def compare(rows_in: DataFrame, cross: bool) -> DataFrame:
        dealt = rows_in.join(sets, "node").repartition("centre", "block", "chunk").sortWithinPartitions("centre", "block", "chunk")
        return dealt.mapInArrow(_blocks(threshold, cross), schema)

    within = written(compare(first, False), "near-dup-links", tables)
    far = within.where("far").select(F.col("a").alias("centre"), F.col("b").alias("node")).distinct()
    if far.isEmpty():
        return within.select("a", "b")
    n_far = written(far.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("n_chunks")), "near-dup-chunks", tables)
    far = written(far.join(n_far, "centre").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(11)), F.col("n_chunks")).cast("int")).join(groups, "centre"), "near-dup-far", tables)
    ones = far.select("centre", "node", "n_blocks", "chunk", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(1).alias("role"))
    others = placed.join(n_far, "centre").select("centre", "node", "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), "block", F.lit(0).alias("role"))
    across = compare(ones.unionByName(others), True)
    return within.where("not far").select("a", "b").unionByName(across.select("a", "b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes that have an edge.

    Large-star and small-star rounds, each a written table: rows stay within
    the number of edges and rounds within the logarithm of the longest path.
    """
    spark, tables = edges.sparkSession, []
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components", tables)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined back, so the node of a large star can be split
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low", tables)
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components", tables)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.hint("merge"), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        of_round: list[str] = []
        small = written(small, "components", of_round)
        drop_tables(spark, tables)
        tables = of_round
        # every node points at one root, and no root points on
        done = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and small.select("u").join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        now = small
        if done:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, with_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sketch of ``df``, and (node, low, n, root) of each node, with its first row's ``first`` if keys are asked for."""
    sketch = written(sketches(df, id_col, text_col, words, bands, rows, with_key), "near-dup-sketch")
    tables: list[str] = []
    found = components(links(df, sketch, id_col, text_col, words, threshold, bands, rows, block, tables))
    drop_tables(df.sparkSession, tables)
    first = [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")] if with_key else []
    counted = sketch.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), *first)
    return sketch, counted.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: its id, ``class_id`` (smallest id of its class), ``class_rows``, ``n_shingles`` and ``class_key`` (no other class has it)."""
    sketch, rooted = _rooted(df, id_col, text_col, words, threshold, bands, rows, block)
    named = written(rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_rows")), "near-dup-named")
    of_node = written(rooted.join(named.hint("merge"), "root").select("node", "root", "class_id", "class_rows"), "near-dup-classes")
    joined = sketch.select("id", "node", "n_shingles").join(of_node.hint("merge"), "node")
    return joined.select(F.col("id").alias(id_col), "class_id", "class_rows", "n_shingles", F.hex("root").alias("class_key"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when each class keeps one: that of its smallest id, once."""
    key = fresh(df, "kept")
    _, rooted = _rooted(df, id_col, text_col, with_key=True, **options)
    kept = written(rooted.groupBy("root").agg(F.min("first")["key"].alias(key)).select(key), "near-dup-kept")
    rows = df.withColumn(key, row_key(F.col(id_col), text=text_or_empty(text_col))).join(kept, key, "left_semi")
    return rows.dropDuplicates([key]).select(*df.columns)


__all__ = ["classes", "components", "keep_one", "links", "sketches"]
