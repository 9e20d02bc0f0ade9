"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are dealt by nearness: to the nearest of at most ``PIVOTS`` points,
which are fitted on a sample of at most ``SAMPLE`` vectors (they decide where a
vector lies, never whether it counts), and by a hash of the id into shards of
bounded size.  Each shard gets a ball tree, built once and kept beside its
vectors: nodes hold a centre and a radius, and no inner product of a query with
a node's vector exceeds ``q . centre + |q| * radius``.  Queries are dealt
likewise into blocks of bounded size.  A task holds one shard at a time and the
blocks stream past it, so a shard crosses the network once a round.  All queries
of a block are searched at once: pairs of query and node go down the tree while
their bound reaches the query's current kth score, leaves are visited in falling
order of bound, and each leaf raises the kth scores for the next.

Shards share the kth score: in a first round every block is searched for in one
shard near it, and what it finds there is the score that all other shards start
with in the second.  No pair of a query and a vector leaves a task unless it is
among the k best of its shard.

Vectors and queries whose components are too large for exact products of floats
are compared in whole numbers of any length, by themselves: with all queries and
all vectors of the shard.  That is slow, and exact.

Defined results: components become floor(scale * x), and scores are exact at
every size; a score that 64 bits do not hold, among a shard's best, ends the run
with an error, as the result has no place for it; vectors that are null or hold null or non-finite components
take no part; a shorter vector counts as filled up with zeros; ties go to the
smaller id; rows that share a query's id are its own and no candidates of it,
and a query is asked once for each id (of rows that repeat an id, the smallest
vector); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, written

SCALE, K = 64, 20
SHARD_ROWS, QUERY_ROWS, LEAF = 8_192, 2_048, 128
PIVOTS, SAMPLE = 256, 4_096


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): whole-number vectors of the rows that take part."""
    # a float of 2**53 or more is whole; floor() would hold it to 64 bits
    x = F.transform(F.transform(F.col(vector_col), lambda e: F.lit(float(scale)) * e.cast("double")), lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y))
    fine = F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(vector_col, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))), F.lit(True))
    return df.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _matrix_of(vectors):
    """Vectors of any length as one matrix, filled up with zeros."""
    import numpy as np

    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def pivots(rows: DataFrame, n: int):
    """At most ``n`` points among which vectors lie close together, from a sample by a hash of the id."""
    import numpy as np

    found = _matrix_of([r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).collect()])  # at most SAMPLE rows
    out = found[: max(1, min(n, PIVOTS, len(found)))].copy()
    with np.errstate(all="ignore"):
        for _ in range(8 if len(out) > 1 else 0):
            near = _nearest(found, out)
            for k in range(len(out)):
                if (own := near == k).any():
                    out[k] = found[own].mean(axis=0)
    return out


def _nearest(vectors, points):
    import numpy as np

    d = max(vectors.shape[1], points.shape[1])
    v, p = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (vectors, points))
    with np.errstate(all="ignore"):
        return np.argmin((p * p).sum(axis=1)[None, :] - 2.0 * (v @ p.T), axis=1)


def dealt(rows: DataFrame, points, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, v, part) with parts of about ``size`` rows that are near one point, and the first part of each point."""
    shared = rows.sparkSession.sparkContext.broadcast(points)  # at most PIVOTS points

    def run(reader):
        import pyarrow as pa

        for batch in reader:
            if len(batch):
                near = _nearest(_matrix_of(batch.column("v").to_pylist()), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near, pa.int32())], ["id", "v", "near"])

    placed = written(rows.mapInArrow(run, "id bigint, v array<double>, near int"), "topk-dealt")
    counts = sorted(tuple(r) for r in placed.groupBy("near").count().collect())  # a row for each point
    first, plan = {}, []
    at = 0
    for near, n in counts:
        parts = -(-n // size)
        first[near] = at
        plan.append((near, at, parts))
        at += parts
    spread = rows.sparkSession.createDataFrame(plan, "near int, first int, parts int")
    part = F.col("first") + F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")
    return placed.join(F.broadcast(spread), "near").select("id", "v", part.cast("bigint").alias("part"), "near"), first


def blobs(rows: DataFrame, name: str, leaf: int | None = None) -> DataFrame:
    """(part, near, n, d, ids, vectors, tree): each part as one row of bytes, with its ball tree if ``leaf`` is given."""

    def run(reader):
        import numpy as np
        import pyarrow as pa

        held: dict[tuple, list] = {}
        for batch in reader:
            for part, near, id_, v in zip(*(batch.column(x).to_pylist() for x in ("part", "near", "id", "v"))):
                held.setdefault((part, near), []).append((id_, v))
        for part, near in sorted(held):
            found = sorted(held.pop((part, near)))
            matrix = _matrix_of([v for _, v in found])
            tree = BallTree(matrix, leaf).packed() if leaf else None
            if not matrix.size or np.abs(matrix).max() < 1 << 31:
                small = matrix.astype(np.int32)
            else:
                small = matrix
            out = (part, near, len(found), matrix.shape[1], np.array([i for i, _ in found], dtype=np.int64).tobytes(), small.tobytes(), tree)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "near", "n", "d", "ids", "vectors", "tree"])

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(rows.repartition(n, "part").mapInArrow(run, "part bigint, near int, n bigint, d bigint, ids binary, vectors binary, tree binary"), name)


class BallTree:
    """Nodes in breadth-first order; a node's vectors are one range of the reordered rows."""

    @classmethod
    def unpacked(cls, raw: bytes) -> BallTree:
        import io

        import numpy as np

        out = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as held:
            for name in held.files:
                setattr(out, name, held[name])
        return out

    def packed(self) -> bytes:
        """The tree as bytes, without the vectors."""
        import io

        import numpy as np

        out = io.BytesIO()
        np.savez(out, order=self.order, lo=self.lo, hi=self.hi, left=self.left, centres=self.centres, radii=self.radii, leaves_at=self.leaves_at)
        return out.getvalue()

    def __init__(self, vectors, leaf: int = LEAF):
        import numpy as np

        with np.errstate(all="ignore"):
            self._build(vectors, leaf)

    def _build(self, vectors, leaf: int) -> None:
        import numpy as np

        self.order = np.arange(len(vectors))
        data = vectors.astype(np.float64)
        self.lo, self.hi, self.left, centres, radii = [0], [len(vectors)], [], [], []
        k = 0
        while k < len(self.lo):
            a, b = self.lo[k], self.hi[k]
            own = data[self.order[a:b]]
            centre = own.mean(axis=0)
            gap = own - centre
            far = np.einsum("ij,ij->i", gap, gap)
            centres.append(centre)
            radii.append(float(np.sqrt(far.max())))
            self.left.append(-1)
            if b - a > leaf and far.max() > 0:
                # split between the vector farthest from the centre and the one farthest from that
                one = own[far.argmax()]
                two = own[((own - one) ** 2).sum(axis=1).argmax()]
                along = own @ (two - one)
                cut = np.argsort(along, kind="stable")
                self.order[a:b] = self.order[a:b][cut]
                self.left[k] = len(self.lo)
                middle = (a + b) // 2
                self.lo += [a, middle]
                self.hi += [middle, b]
            k += 1
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.leaves_at = np.array(self.left) < 0
        self.left = np.array(self.left)

    def bounds(self, queries, norms, q, node, centres):
        """Upper bounds of inner products for pairs of query and node, a little above against rounding."""
        import numpy as np

        dot = np.einsum("ij,ij->i", queries[q], centres[node])
        return dot + norms[q] * self.radii[node] + 1e-6 * (1.0 + np.abs(dot))


def _matrix(data: bytes, n: int, d: int):
    """The rows of ``blobs``: four bytes a component where they suffice, else floats that are whole."""
    import numpy as np

    return np.frombuffer(data, np.int32 if len(data) == 4 * n * d else np.float64).reshape(n, d)


def search_all(vectors, ids, queries, query_ids, floor, k: int = K, leaf: int = LEAF, tree: BallTree | None = None):
    """``search`` for components of every size; of the vectors or queries that it cannot hold, the k best by whole numbers, whatever their ``floor``."""
    import heapq
    from math import isqrt

    import numpy as np

    d = max(1, vectors.shape[1], queries.shape[1])
    size = 1 << max(1, len(vectors) - 1).bit_length()
    # a code of score and place stays below 2**62, and so do sums of products below 2**53
    most = isqrt(min((1 << 61) // size, 1 << 52) // d)
    large_v, large_q = ((np.abs(x.astype(np.float64)) > most).any(axis=1) for x in (vectors, queries))
    if not large_v.any() and not large_q.any():
        return search(vectors, ids, queries, query_ids, floor, k, leaf, tree)
    small_v, small_q = np.flatnonzero(~large_v), np.flatnonzero(~large_q)
    who, found, score = [], [], []
    if len(small_v) and len(small_q):
        a, b, c = search(vectors[small_v], ids[small_v], queries[small_q], query_ids[small_q], floor[small_q], k, leaf)
        who, found, score = small_q[a].tolist(), b.tolist(), c.tolist()
    width = min(vectors.shape[1], queries.shape[1])
    whole = lambda x: [[int(e) for e in row[:width]] for row in x.tolist()]
    everything = whole(vectors) if large_q.any() else None
    few = [(i, v) for i, v in zip(ids[large_v].tolist(), whole(vectors[large_v]))]
    for n, asked in enumerate(whole(queries)):
        against = zip(ids.tolist(), everything) if large_q[n] else few
        best = heapq.nsmallest(k, ((-sum(a * b for a, b in zip(asked, v)), i) for i, v in against if i != query_ids[n]))
        who += [n] * len(best)
        found += [i for _, i in best]
        score += [-s for s, _ in best]
    if any(not -(1 << 63) <= x < 1 << 63 for x in score):
        raise OverflowError("a score that 64 bits do not hold")
    return tuple(np.array(x, dtype=np.int64) for x in (who, found, score))


def search(vectors, ids, queries, query_ids, floor, k: int = K, leaf: int = LEAF, tree: BallTree | None = None, visits: list | None = None):
    """The k best of one shard for every query: (query's place, id, score); scores below ``floor`` are left out.

    ``ids`` ascend.  A code of score and place orders candidates: higher score first, then smaller id.
    ``visits`` takes the number of leaves that queries visit, and of all leaves there are for them.
    """
    import numpy as np

    tree = tree or BallTree(vectors, leaf)
    n, m = len(vectors), len(queries)
    d = max(vectors.shape[1], queries.shape[1])
    wide = lambda x: np.pad(x.astype(np.float64), ((0, 0), (0, d - x.shape[1])))
    data, asked = wide(vectors)[tree.order], wide(queries)
    centres = np.pad(tree.centres, ((0, 0), (0, d - tree.centres.shape[1])))
    norms = np.sqrt((asked**2).sum(axis=1))
    places = tree.order.astype(np.int64)
    size = 1 << max(1, n - 1).bit_length()
    best, seen = np.full((m, k), np.iinfo(np.int64).min, dtype=np.int64), 0
    kth = np.asarray(floor, dtype=np.float64).copy()
    q, node = np.arange(m), np.zeros(m, dtype=np.int64)
    at_leaf_q, at_leaf, at_bound = [], [], []
    while len(q):
        bound = tree.bounds(asked, norms, q, node, centres)
        live = bound >= kth[q]
        q, node, bound = q[live], node[live], bound[live]
        ends = tree.leaves_at[node]
        at_leaf_q.append(q[ends]), at_leaf.append(node[ends]), at_bound.append(bound[ends])
        q, node = np.repeat(q[~ends], 2), np.stack([tree.left[node[~ends]], tree.left[node[~ends]] + 1], axis=1).ravel()
    lq, ln, lb = (np.concatenate(x) if x else np.empty(0) for x in (at_leaf_q, at_leaf, at_bound))
    # a query's leaves in falling order of bound: turn t holds each query's t-th leaf
    order = np.lexsort((-lb, lq))
    lq, ln, lb = lq[order].astype(np.int64), ln[order].astype(np.int64), lb[order]
    first = np.searchsorted(lq, np.arange(m))
    turn = np.arange(len(lq)) - first[lq] if len(lq) else lq
    by_turn = np.lexsort((ln, turn))
    starts = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2)) if len(lq) else [0]
    for t in range(len(starts) - 1):
        now = by_turn[starts[t] : starts[t + 1]]
        now = now[lb[now] >= kth[lq[now]]]
        if not len(now):
            continue
        seen += len(now)
        for leaf_now in np.split(now, np.flatnonzero(np.diff(ln[now])) + 1):
            who, a, b = lq[leaf_now], tree.lo[ln[leaf_now[0]]], tree.hi[ln[leaf_now[0]]]
            score = (asked[who] @ data[a:b].T).astype(np.int64)
            code = score * size + (size - 1 - places[a:b])
            code[(score < kth[who, None]) | (ids[places[a:b]][None, :] == query_ids[who, None])] = np.iinfo(np.int64).min
            both = np.concatenate([best[who], code], axis=1)
            both.partition(both.shape[1] - k, axis=1)
            best[who] = both[:, -k:]
            low = best[who].min(axis=1)
            kth[who] = np.where(low > np.iinfo(np.int64).min, np.maximum(kth[who], low // size), kth[who])
    if visits is not None:
        visits.append((seen, m * int(tree.leaves_at.sum())))
    who, column = np.nonzero(best > np.iinfo(np.int64).min)
    code = best[who, column]
    return who, ids[size - 1 - code % size], code // size


def _search_blobs(k: int, leaf: int):
    """Rows sorted by shard, each shard before the blocks that are searched for in it."""

    def run(reader):
        import numpy as np
        import pyarrow as pa

        shard = None
        for batch in reader:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                vectors, ids = _matrix(r["vectors"], r["n"], r["d"]), np.frombuffer(r["ids"], np.int64)
                if r["q_part"] is None:
                    shard = (r["part"], vectors, ids, BallTree.unpacked(r["tree"]))
                    continue
                floor = np.frombuffer(r["floor"], np.float64) if r["floor"] is not None else np.full(len(ids), -np.inf)
                who, found, score = search_all(shard[1], shard[2], vectors, ids, floor, k, leaf, shard[3])
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), r["q_part"])), pa.array(who.astype(np.int64)), pa.array(ids[who]), pa.array(found), pa.array(score)], ["q_part", "place", "query_id", "vec_id", "score"])

    return run


_FOUND = "q_part bigint, place bigint, query_id bigint, vec_id bigint, score bigint"


def _searched(shards: DataFrame, blocks: DataFrame, k: int, leaf: int) -> DataFrame:
    """What blocks (part, q_part, n, d, ids, vectors, floor) find in the shards whose part they name."""
    columns = ["part", "q_part", "n", "d", "ids", "vectors", "tree", "floor"]
    held = shards.join(blocks.select("part").distinct(), "part", "left_semi").withColumns({"q_part": F.lit(None).cast("bigint"), "floor": F.lit(None).cast("binary")})
    both = held.select(*columns).unionByName(blocks.withColumn("tree", F.lit(None).cast("binary")).select(*columns))
    n = 4 * int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "part").sortWithinPartitions("part", F.col("q_part").asc_nulls_first()).mapInArrow(_search_blobs(k, leaf), _FOUND)


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    leaf: int = LEAF,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the k rows of ``df`` with the highest inner product."""
    need(df, id_col, vector_col)
    need(queries, id_col, vector_col)
    vectors = written(quantised(df, id_col, vector_col, scale), "topk-vectors")
    asked = written(quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    n = vectors.count()
    if not n or asked.isEmpty():
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    points = pivots(vectors, -(-n // shard_rows))
    placed, first = dealt(vectors, points, shard_rows)
    shards = blobs(placed, "topk-shards", leaf)
    blocks = blobs(dealt(asked, points, query_rows)[0], "topk-blocks")
    # a block's home is the first shard near its point, or any if no vector is near that
    home = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("near")), F.lit(0)).cast("bigint")
    blocks = blocks.select(F.col("part").alias("q_part"), "n", "d", "ids", "vectors", home.alias("home"))
    seed = written(_searched(shards, blocks.withColumns({"part": F.col("home"), "floor": F.lit(None).cast("binary")}), k, leaf), "topk-seed")
    # the kth score of each query in its home, in the order of its block
    kth = seed.groupBy("q_part", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    kth = kth.select("q_part", F.struct("place", F.when(F.col("n") >= k, F.col("low").cast("double")).alias("low")).alias("x")).groupBy("q_part").agg(F.sort_array(F.collect_list("x")).alias("low"))

    def packed(reader):
        import numpy as np
        import pyarrow as pa

        for batch in reader:
            out = []
            for n, low in zip(batch.column("n").to_pylist(), batch.column("low").to_pylist()):
                floor = np.full(n, -np.inf)
                for x in low or []:
                    if x["low"] is not None:
                        floor[x["place"]] = x["low"]
                out.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("q_part"), pa.array(out, pa.binary())], ["q_part", "floor"])

    floors = blocks.select("q_part", "n").join(kth, "q_part", "left").mapInArrow(packed, "q_part bigint, floor binary")
    # blocks against all other shards: a stated query set in blocks, not rows against rows
    parts = shards.agg(F.max("part")).first()[0]
    others = blocks.join(floors, "q_part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))).where("part <> home")
    rest = _searched(shards, others.withColumn("part", F.col("part").cast("bigint")), k, leaf)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = seed.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
