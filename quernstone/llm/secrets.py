"""Secrets in texts, judged by how many owners and repositories hold the same value.

All of it is column expressions.  Regular expressions find candidate values and
their places; a value's hash is counted over distinct repositories and owners
of the whole corpus.  A value that many owners hold is a copied example; one
that stays with few owners looks live.  Spans count code points, ends excluded.

A span's place comes from cutting the text at the matches: the lengths of the
pieces and matches before it add up to its start.

Defined results: a null text counts as empty; a null owner or repository counts
as one of its own; repeated rows each get their result and count once; an empty
table gives no rows; other columns of the table do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, need, text_or_empty, written

#: The kinds in their order among spans that begin at one place: the pattern, the group with the value, its least length.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    # what this operator looks for beyond the first three; its spans count only if the value looks live
    "key": (
        r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[rs]k_live_[0-9A-Za-z]{16,}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        0,
        10,
    ),
}
NAMES = list(KINDS)
#: A value held by more owners than this is an example.
MOST_OWNERS = 2
MASK = "<SECRET>"


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start,kind,end,value>> of one kind's matches; the value is a hash."""
    pattern, group, least = KINDS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    joined = F.arrays_zip(pieces.alias("skip"), hits.alias("hit"), values.alias("value"))
    element = "struct<start:int,kind:int,end:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{element}>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["skip"]
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(NAMES.index(kind)).alias("kind"), end.alias("end"), F.md5(x["value"].cast("binary")).alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    hit = F.filter(joined, lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(hit, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{element}>"))


def row_key(*columns: Column, text: Column) -> Column:
    """A digest that equal rows share; it stands for the row in joins that need not carry the text."""
    parts = [F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-")) for x in columns]
    return F.sha2(F.concat_ws("\x1f", *parts, F.sha2(text.cast("binary"), 256)), 256)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """(id, owner, repository, key, spans): every candidate of every text, in one scan."""
    need(df, id_col, text_col, owner_col)
    text = text_or_empty(text_col)
    repository = F.col(repository_col or id_col).cast("string")
    return df.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        repository.alias("repository"),
        row_key(F.col(id_col), F.col(owner_col), repository, text=text).alias("key"),
        F.array_sort(F.concat(*(_spans(text, x) for x in NAMES))).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories): in how many distinct owners and repositories each value stands."""
    held = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda x: x["value"]))).alias("value"))
    # one row for each holder first, so a value that a third of all rows hold is counted where it is read
    by_owner = held.distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    pairs = held.select("value", "repository").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners")).join(pairs, "value")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per row: id, key and ``spans``: array<struct<start,kind,end,live,owners,repositories>> in order.

    The base kinds stay whatever their verdict; a span of kind ``key`` stays only if it looks live.
    """
    found = written(candidates(df, id_col, text_col, owner_col, repository_col), "secret-candidates")
    some = found.where(F.size("spans") > 0)
    each = some.select("key", F.explode("spans").alias("s")).select("key", "s.*")
    # counts are written before they are joined back, so a value that many rows hold can be split
    judged = each.join(written(ownership(some), "secret-owners"), "value").withColumn("live", F.col("owners") <= most_owners)
    extra = NAMES.index("key")
    judged = judged.where((F.col("kind") != extra) | F.col("live"))
    whole = judged.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("spans"))
    empty = F.array().cast(whole.schema["spans"].dataType)
    return found.select("id", "key").join(whole, "key", "left").select(F.col("id").alias(id_col), "key", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(x) for x in NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``scan`` as counts and digests."""
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(k: int):
        return count(lambda x: x["kind"] == k).alias(f"n_{NAMES[k]}")

    return found.select(
        id_col,
        *(of_kind(k) for k in range(3)),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``df`` with every live-looking span of its texts replaced; its columns stay the same."""
    need(df, id_col, text_col, owner_col)
    found = scan(df, id_col, text_col, owner_col, **options)
    key, live, new = (fresh(df, x) for x in ("mask_key", "mask_live", "mask_text"))
    spans = found.select(F.col("key").alias(key), F.filter("spans", lambda x: x["live"]).alias(live)).where(F.size(live) > 0)
    spans = spans.groupBy(key).agg(F.first(live).alias(live))
    text = text_or_empty(text_col)
    repository = F.col(options.get("repository_col") or id_col).cast("string")
    joined = df.withColumn(key, row_key(F.col(id_col), F.col(owner_col), repository, text=text)).join(spans, key, "left")

    def step(acc, x):
        gap = F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(MASK)).alias("out"))).otherwise(
            F.struct(F.greatest(x["end"], acc["at"]).alias("at"), acc["out"].alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(live, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    done = joined.withColumn(new, F.when(F.col(live).isNotNull(), masked).otherwise(F.col(text_col)))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col(new).alias(name)
        if name == length_col:
            return F.when(F.col(live).isNotNull(), F.length(new).cast(df.schema[name].dataType)).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return done.select(*(column(x) for x in df.columns))
