"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (its lines) are hashed to 64-bit digests, its set of keys.
The fingerprint is the serialised table itself, so two texts are compared by
their fingerprints alone.

A table has groups, a power of two in proportion to the keys, so that each holds
a few; a key belongs to one group by hash and to one cell in each of the group's
three rows.  A cell holds the number of its keys, the XOR of the keys and the
XOR of their check hashes.  Subtracting two tables cell by cell leaves the keys
that only one of them has; peeling takes out keys that stand alone in a cell
until nothing is left, which recovers the differing digests and their sides.

Each group of a fingerprint is large enough to be peeled whole: one that does
not come out empty is built again with four times the cells.  So a fingerprint
gives back all of its own digests, and where two tables differ in shape, or
their difference does not come out empty, the groups in question are dealt out
to larger ones from these, until it does.

All of it is column expressions on arrays: a text's keys are sorted by group
once, and work is in proportion to them.  A document never leaves its row.

The text of a fingerprint: lines/groups/ and then, for each group that is not
empty, number:cells a row: and its cells that are not empty as place,n,keys,checks
joined by semicolons; groups are joined by bars.

Defined results: a null text counts as empty, and an empty text is one empty
paragraph; a paragraph that a text repeats is one key, so texts that differ only
in repeats or in the order of lines have like tables, and their fingerprints
differ by the number of lines at most; equal texts have equal fingerprints; an
empty table gives no rows.  Keys whose places agree in the largest table (two in
2**36 pairs of a group) cannot be told apart by it: the group counts as different.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, need, text_or_empty

#: Keys that a group holds on average, at most.
GROUP_KEYS = 4
#: Cells in each of a group's three rows: the first try, and the retries.
ROW_CELLS = (8, 32, 128, 512, 4096)
#: Rounds of peeling; each takes out all keys that stand alone, and rounds after the last key cost nothing.
ROUNDS = 24
_GROUP, _CHECK, _PLACE = 5, 99, 1000
_KEYS = "array<struct<n:int,k:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b).cast("int")


def digests(text: Column) -> Column:
    """The distinct paragraphs' digests."""
    return F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.xxhash64(x)))


def n_groups(keys: Column) -> Column:
    """The number of groups for a set of keys, a power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(keys) / F.lit(float(GROUP_KEYS)), F.lit(1.0))))).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_CHECK)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _holds(key: Column, at: Column, cells: Column) -> Column:
    """Whether a key belongs to the cell ``at`` of a group's three rows."""
    return F.pmod(F.xxhash64(key, _div(at, cells) + _PLACE), cells) == F.pmod(at, cells)


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), h.alias("h"))


def _without(cell: Column, keys: Column) -> Column:
    """A cell without some keys, each taken away as often as its side says."""
    return F.aggregate(keys, cell, lambda c, p: _cell(c["n"] - p["n"], c["k"].bitwiseXOR(p["k"]), c["h"].bitwiseXOR(_check(p["k"]))))


def _nothing() -> Column:
    zero = F.lit(0).cast("long")
    return _cell(F.lit(0), zero, zero)


def table(keys: Column, cells: Column) -> Column:
    """array<struct<n:int,k:bigint,h:bigint>>: a group's cells, row after row."""
    minus = F.transform(keys, lambda k: F.struct(F.lit(-1).alias("n"), k.alias("k")))
    return _let(minus, lambda own: F.transform(F.sequence(F.lit(0), 3 * cells - 1), lambda at: _without(_nothing(), F.filter(own, lambda p: _holds(p["k"], at, cells)))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(difference: Column, cells: Column) -> Column:
    """array<struct<n,k>>: the differing keys, n = 1 for those of the first table and -1 for the second's; null if cells are left."""

    def one(state, _):
        alone = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])))
        keys = F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))
        held = F.struct(state["cells"].alias("cells"), state["found"].alias("found"))

        def out(keys):
            left = F.transform(state["cells"], lambda c, at: _without(c, F.filter(keys, lambda p: _holds(p["k"], at, cells))))
            return F.when(F.size(keys) == 0, held).otherwise(F.struct(left.alias("cells"), F.concat(state["found"], keys).alias("found")))

        return _let(keys, out)

    start = F.struct(difference.alias("cells"), F.array().cast(_KEYS).alias("found"))
    empty = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, x: F.when(F.size(s["found"]).isNull() | empty(s), s).otherwise(one(s, x)), lambda s: F.when(empty(s), s["found"]))


def _first(sizes: tuple[int, ...], attempt, kind: str) -> Column:
    """The first of ``attempt(size)`` that is not null."""
    return F.aggregate(F.array(*(F.lit(x) for x in sizes)), F.lit(None).cast(kind), lambda found, size: F.when(found.isNotNull(), found).otherwise(attempt(size)))


def _by_group(rows: Column) -> Column:
    """An array of structs sorted by their field ``g`` as an array of arrays, one for each ``g``."""

    def cut(rows):
        number = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(number, lambda i: (i == 0) | (F.get(rows, i)["g"] != F.get(rows, i - 1)["g"]))
        return _let(starts, lambda s: F.transform(s, lambda a, j: F.slice(rows, a + 1, F.coalesce(F.get(s, j + 1), F.size(rows)) - a)))

    return _let(rows, cut)


_GROUPS = "struct<g:int,c:int,cells:array<struct<at:int,n:int,k:bigint,h:bigint>>>"


def _kept(group: Column, keys: Column) -> Column:
    """A group of these keys, with the first number of cells from which they all come back."""

    def attempt(c):
        def told(cells):
            numbered = F.transform(cells, lambda x, at: F.struct(at.alias("at"), x["n"].alias("n"), x["k"].alias("k"), x["h"].alias("h")))
            full = F.filter(numbered, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))
            return F.when(peel(cells, c).isNotNull() | (c == ROW_CELLS[-1]), F.struct(group.alias("g"), c.alias("c"), full.alias("cells")).cast(_GROUPS))

        return _let(table(keys, c), told)

    return _first(ROW_CELLS, attempt, _GROUPS)


def groups_of(keys: Column, groups: Column) -> Column:
    """The groups of a set of keys that are not empty, in order."""
    dealt = F.sort_array(F.transform(keys, lambda k: F.struct(F.pmod(F.xxhash64(k, F.lit(_GROUP)), groups).cast("int").alias("g"), k.alias("k"))))
    return F.transform(_by_group(dealt), lambda part: _kept(part[0]["g"], F.transform(part, lambda x: x["k"])))


def _told(group: Column) -> Column:
    cells = F.transform(group["cells"], lambda x: F.concat_ws(",", *(x[f].cast("string") for f in ("at", "n", "k", "h"))))
    return F.concat_ws(":", group["g"].cast("string"), group["c"].cast("string"), F.array_join(cells, ";"))


def fingerprint(text: Column) -> Column:
    """A text's table as a string."""

    def out(keys):
        told = F.array_join(F.transform(groups_of(keys, n_groups(keys)), _told), "|")
        return F.concat_ws("/", F.size(F.split(text, "\n")).cast("string"), n_groups(keys).cast("string"), told)

    return _let(digests(text), out)


def read(told: Column) -> Column:
    """struct<groups:int,table:array<group>> from a fingerprint."""

    def group(x):
        p = F.split(x, ":")
        cells = F.transform(F.filter(F.split(p[2], ";"), lambda y: y != ""), lambda y: _let(F.split(y, ","), lambda v: F.struct(v[0].cast("int").alias("at"), v[1].cast("int").alias("n"), v[2].cast("long").alias("k"), v[3].cast("long").alias("h"))))
        return F.struct(p[0].cast("int").alias("g"), p[1].cast("int").alias("c"), cells.alias("cells"))

    def out(p):
        return F.struct(p[1].cast("int").alias("groups"), F.transform(F.filter(F.split(p[2], "\\|"), lambda x: x != ""), group).alias("table"))

    return _let(F.split(told, "/"), out)


def _all_cells(group: Column, cells: Column) -> Column:
    """A group's cells, the empty ones too."""
    return F.transform(F.sequence(F.lit(0), 3 * cells - 1), lambda at: F.coalesce(F.get(F.transform(F.filter(group["cells"], lambda x: x["at"] == at), lambda x: _cell(x["n"], x["k"], x["h"])), F.lit(0)), _nothing()))


def group_keys(group: Column) -> Column:
    """The keys of a group, peeled out of its cells."""
    return F.transform(peel(_all_cells(group, group["c"]), group["c"]), lambda x: x["k"])


def n_keys(table: Column) -> Column:
    """The number of keys in a table's groups: each is counted in three cells."""
    return F.aggregate(table, F.lit(0), lambda total, g: total + F.aggregate(g["cells"], F.lit(0), lambda n, x: n + x["n"])) / 3


def _different(a: Column, b: Column) -> Column:
    """How many keys differ between two groups of one number."""
    larger = F.greatest(a["c"], b["c"])

    def side(x, c):
        return F.when(x["c"] == c, _all_cells(x, c)).otherwise(table(group_keys(x), c))

    count = _first(ROW_CELLS, lambda c: F.when(c >= larger, F.size(peel(subtract(side(a, c), side(b, c)), c))), "int")
    return F.coalesce(count.cast("double"), n_keys(F.array(a)) + n_keys(F.array(b)))


def with_likeness(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """``df`` with the share of common keys among all of two texts, from the columns of their fingerprints alone.

    Step by step in columns of their own, as one expression would be too deep for the analyser.
    """
    read_a, read_b, groups, dealt_a, dealt_b, pairs, total, different = names = [fresh(df, f"iblt_{x}") for x in ("a", "b", "groups", "dealt_a", "dealt_b", "pairs", "total", "different")]

    def dealt(x, sign):
        table = F.when(F.col(x)["groups"] == F.col(groups), F.col(x)["table"]).otherwise(groups_of(F.flatten(F.transform(F.col(x)["table"], group_keys)), F.col(groups)))
        return F.transform(table, lambda g: F.struct(g["g"].alias("g"), F.lit(sign).alias("side"), g.alias("group")))

    def one(part):
        return F.when(F.size(part) == 1, n_keys(F.array(part[0]["group"]))).otherwise(_different(part[0]["group"], F.get(part, F.lit(1))["group"]))

    out = df.withColumns({read_a: read(F.col(a)), read_b: read(F.col(b))})
    out = out.withColumns({groups: F.greatest(F.col(read_a)["groups"], F.col(read_b)["groups"]), total: n_keys(F.col(read_a)["table"]) + n_keys(F.col(read_b)["table"])})
    out = out.withColumns({dealt_a: dealt(read_a, 0), dealt_b: dealt(read_b, 1)})
    out = out.withColumn(pairs, _by_group(F.sort_array(F.concat(dealt_a, dealt_b))))
    out = out.withColumn(different, F.aggregate(pairs, F.lit(0.0), lambda n, part: n + one(part)))
    same = (F.col(total) - F.col(different)) / (F.col(total) + F.col(different))
    return out.withColumn(to, F.when(F.col(a) == F.col(b), 1.0).otherwise(same).cast("double")).drop(*names)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1000, most_buckets: int = 20_000) -> DataFrame:
    """(id, text, told, next, next_told): every text and its fingerprint with those of the next document in descending order of id, after the last the first.

    Rows are dealt into ranges of ids of about equal size, ordered inside each
    range, and each range also gets a copy of the first row of the next one; so
    texts move once and no task orders all rows.  Ties in id go by the text's
    hash; null ids come last.  Where all ids are null the last one's next is empty.
    """
    need(df, id_col, text_col)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n = rows.count()
    wanted = min(most_buckets, max(1, -(-n // bucket_rows)))
    # at most most_buckets numbers come to the driver
    cut = rows.select(F.percentile_approx("id", [k / wanted for k in range(1, wanted)], max(10_000, 20 * wanted)).alias("x")).first()["x"] if wanted > 1 else []
    bounds = sorted({x for x in cut or []})
    if bounds:
        steps = [1 << k for k in reversed(range(max(1, math.ceil(math.log2(len(bounds) + 1)))))]
        held = F.lit(bounds)

        def step(low, size):
            reach = low + size
            return F.when((reach <= len(bounds)) & (F.get(held, F.least(reach, F.lit(len(bounds))) - 1) <= F.col("id")), reach).otherwise(low)

        bucket = F.aggregate(F.lit(steps), F.lit(0), step)
    else:
        bucket = F.lit(0)
    placed = rows.withColumn("bucket", bucket)
    tops = sorted(((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("id").alias("top")).collect()), reverse=True)  # a row for each range
    following = [(b, tops[(k + 1) % len(tops)][1]) for k, (b, _) in enumerate(tops)]
    firsts = spark.createDataFrame([x for x in following if x[1] is not None], "bucket int, top bigint")
    copies = rows.join(F.broadcast(firsts), F.col("id") == F.col("top")).select("id", "text", "bucket", F.lit(True).alias("copy"))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    # dealt first, so that fingerprints are made once, behind the shuffle
    both = placed.withColumn("copy", F.lit(False)).unionByName(copies).repartition("bucket").withColumn("told", fingerprint(F.col("text")))
    both = both.withColumns({"next": F.lead("text").over(order), "next_told": F.lead("told").over(order)})
    none = F.when(F.col("next").isNull(), fingerprint(F.lit(""))).otherwise(F.col("next_told"))
    return both.where(~F.col("copy")).select("id", "text", "told", F.coalesce("next", F.lit("")).alias("next"), none.alias("next_told"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last half of the code points replaced by the first
    as many (or all) of the next document.
    """
    rows = with_next(df, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    cut = rows.select("id", "told", "next_told", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = cut.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "told", "next_told", fingerprint(F.col("edited")).alias("edited_told"))
    both = with_likeness(with_likeness(both, "told", "edited_told", "near_edited"), "told", "next_told", "near_next")
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("told").alias("fingerprint"), F.col("edited_told").alias("edited_fingerprint"), "near_edited", "near_next")
