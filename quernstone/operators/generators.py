"""Deterministic makers of noisy lines, catalogues and ledgers, for tests and benchmarks.

Every choice comes from a hash of the row's key and a seed, so a row is made the
same anywhere and no state passes between rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Abbreviations and words of the second language; the first that occurs is used.
ABBREVIATIONS = (
    ("Stainless 304", "SS304"), ("Stainless 316", "SS316"), ("Stainless", "S/S"), ("Zinc Plated", "ZP"), ("Galvanised", "GALV"), ("Hex Bolt", "HEX BLT"), ("Self Drilling Screw", "SDS"),
    ("Angle Grinder Disc", "GRINDING DISC"), ("Full Cream Milk", "FC MILK"), ("Chicken Breast", "CHK BRST"), ("Unsalted", "UNSLT"), ("Packet", "PKT"), ("Length", "LGT"),
)
WORDS = (
    ("screw", "skru"), ("wire", "dawai"), ("pipe", "paip"), ("glove", "sarung tangan"), ("helmet", "topi keledar"), ("tape", "pita"), ("chicken", "ayam"), ("beef", "daging"),
    ("milk", "susu"), ("prawn", "udang"), ("butter", "mentega"), ("frozen", "beku"), ("white", "putih"), ("black", "hitam"), ("red", "merah"), ("blue", "biru"),
)
PACK_SIZES = (6, 12, 24, 48)
PACK_WORDS = ("ctn", "carton", "box", "case", "pkt", "bag", "dozen", "doz")
FILLERS = ("pls send ", "need ", "item: ", "1) ", "- ", "urgent ", "")
MARKS = ("  ", " - ", "/", " ")
INCHES = ('"', "''", " inch")
JUNK = (
    "thanks bro", "deliver by friday please", "same as last month order", "PO attached", "subtotal", "delivery charge", "pls confirm stock first", "kindly quote best price", "ATTN: purchasing dept", "----",
)
ABSENT = (
    "Makita LS1040 mitre saw 240v", "Duracell AA battery 8 pack", "3M 8210 N95 respirator box 20", "Cadbury Dairy Milk 165g", "Epson 003 ink black bottle", "Nescafe Gold refill 170g", "Copper pipe 22mm x 3m Class 2", "Wagyu striploin MB7 grain fed",
)
#: Classes of order lines and how many of 95 lines belong to each.
CLASSES = {
    "clean": 7, "typo": 10, "abbrev": 9, "bilingual": 7, "sparse": 8, "pack_confusion": 8, "buyer_sku": 10, "barcode": 6, "stale_alias": 9, "ambiguous": 8, "absent": 8, "junk": 5,
}


def chance(key: Column, salt: str) -> Column:
    """A number from 0 to below 1."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def pick(key: Column, salt: str, n: Column | int) -> Column:
    return F.floor(chance(key, salt) * n).cast("int")


def typo(c: Column, key: Column) -> Column:
    """Swap two letters, drop one or double one."""
    at = F.greatest(pick(key, "typo-at", F.greatest(F.length(c) - 1, F.lit(1))), F.lit(0)) + 1
    head, tail = F.substring(c, F.lit(1), at - 1), F.substring(c, at + 2, F.length(c))
    one, two = F.substring(c, at, F.lit(1)), F.substring(c, at + 1, F.lit(1))
    kind = pick(key, "typo-kind", 3)
    return F.when(F.length(c) < 2, c).otherwise(F.when(kind == 0, F.concat(head, two, one, tail)).when(kind == 1, F.concat(head, two, tail)).otherwise(F.concat(head, one, one, two, tail)))


def case(c: Column, key: Column) -> Column:
    kind = pick(key, "case", 3)
    return F.when(kind == 0, F.upper(c)).when(kind == 1, F.lower(c)).otherwise(F.initcap(c))


def _first_of(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    low, out = F.lower(c), c
    for word, other in reversed(pairs):
        out = F.when(low.contains(word.lower()), F.regexp_replace(c, f"(?i){word}", other)).otherwise(out)
    return out


def abbreviate(c: Column) -> Column:
    return _first_of(c, ABBREVIATIONS)


def translate(c: Column) -> Column:
    return _first_of(c, WORDS)


def drop_words(c: Column, key: Column, keep: float = 0.72) -> Column:
    """Of more than three words, keep each with a chance; never none."""
    words = F.split(c, " ")
    kept = F.filter(words, lambda w, k: F.pmod(F.xxhash64(key, w, k), F.lit(1000)) < int(1000 * keep))
    return F.when((F.size(words) > 3) & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(c)


def one_of(values: tuple, key: Column, salt: str) -> Column:
    return F.get(F.array(*(F.lit(x) for x in values)), pick(key, salt, len(values)))


def pack_suffix(c: Column, key: Column) -> Column:
    word = F.when(chance(key, "pack-any") < 0.5, "").otherwise(F.concat(F.lit(" "), one_of(PACK_WORDS, key, "pack-word")))
    return F.concat(c, F.lit(" x"), one_of(PACK_SIZES, key, "pack").cast("string"), word)


def noise_prefix(c: Column, key: Column) -> Column:
    return F.concat(one_of(FILLERS, key, "filler"), c)


def punctuate(c: Column, key: Column) -> Column:
    return F.replace(F.replace(c, F.lit(" "), one_of(MARKS, key, "mark")), F.lit('"'), one_of(INCHES, key, "inch"))


def order_lines(items: DataFrame, aliases: DataFrame, n: int) -> DataFrame:
    """``n`` labelled lines of twelve classes: line_id, tenant, customer_id, gt_class, gt_item_code, raw_text, buyer_sku, raw_barcode.

    ``items`` needs tenant, item_code, item_name, barcode and disabled, ``aliases``
    the mappings' columns.  A line asks for an active item, drawn by a hash of
    its number.  Lines of the last three classes have a blank label; a class
    whose item lacks a mapping or a barcode keeps the item's name as its text.
    """
    live = items.where("disabled = '0'").select("tenant", "item_code", "item_name", "barcode")
    numbered = live.withColumn("place", F.row_number().over(Window.partitionBy("tenant").orderBy(F.xxhash64("item_code"), "item_code")) - 1)
    size = numbered.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_items"))
    turns = size.withColumn("turn", F.row_number().over(Window.orderBy("tenant")) - 1)  # a row for each tenant
    n_tenants = turns.count()
    key, at, reach = F.col("line_id"), F.pmod(F.col("line_id") * 37, F.lit(sum(CLASSES.values()))), 0
    kind = F.lit(None).cast("string")
    for name, weight in CLASSES.items():
        kind = F.when((at >= reach) & (at < reach + weight), name).otherwise(kind)
        reach += weight
    drawn = spark_range(items, n).withColumns({"gt_class": kind, "turn": F.pmod(key, F.lit(n_tenants)).cast("int")}).join(turns, "turn")
    rows = drawn.withColumn("place", pick(key, "item", F.col("n_items"))).join(numbered, ["tenant", "place"])
    of_item = aliases.groupBy("tenant", "item_code").agg(F.min_by(F.struct("customer_id", "customer_sku"), F.struct("customer_id", "customer_sku")).alias("m"))
    stale = of_item.withColumn("item_code", F.regexp_replace("item_code", "-OLD$", "")).where(F.col("m").isNotNull()).join(items.where("item_code LIKE '%-OLD'").select("tenant", F.regexp_replace("item_code", "-OLD$", "").alias("item_code")), ["tenant", "item_code"], "left_semi")
    stale = stale.groupBy("tenant", "item_code").agg(F.max("m").alias("stale"))
    rows = rows.join(of_item, ["tenant", "item_code"], "left").join(stale, ["tenant", "item_code"], "left")
    name, c = F.col("item_name"), F.col("gt_class")
    by_sku, by_code = (c == "buyer_sku") & F.col("m").isNotNull(), (c == "barcode") & (F.coalesce("barcode", F.lit("")) != "")
    by_stale = (c == "stale_alias") & F.col("stale").isNotNull()
    raw = (
        F.when(c == "typo", typo(name, key)).when(c == "abbrev", abbreviate(name)).when(c == "bilingual", translate(name)).when(c == "sparse", drop_words(name, key)).when(c == "pack_confusion", pack_suffix(name, key))
        .when(by_sku | by_code | by_stale, noise_prefix(F.element_at(F.split(name, " "), 1), key))
        .when(c == "ambiguous", F.element_at(F.split(name, " "), -1)).when(c == "absent", one_of(ABSENT, key, "absent")).when(c == "junk", one_of(JUNK, key, "junk")).otherwise(case(name, key))
    )
    held = F.when(by_sku, F.col("m")).when(by_stale, F.col("stale"))
    return rows.select(
        "line_id", "tenant", F.coalesce(held["customer_id"], F.lit("")).alias("customer_id"), c.alias("gt_class"), F.when(c.isin("ambiguous", "absent", "junk"), "").otherwise(F.col("item_code")).alias("gt_item_code"),
        raw.alias("raw_text"), F.coalesce(held["customer_sku"], F.lit("")).alias("buyer_sku"), F.when(by_code, F.col("barcode")).otherwise("").alias("raw_barcode"),
    )


def spark_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "line_id")


def derived_aliases(items: DataFrame, customers: int = 8) -> DataFrame:
    """Mappings of about half of the items: valid ones, expired ones that collide with another item, and ones of superseded items."""
    key = F.col("item_code")
    base = items.where(chance(key, "mapped") < 0.5).select(
        "tenant", F.concat(F.lit("CUST-"), pick(key, "customer", customers).cast("string")).alias("customer_id"), F.concat(F.lit("S"), F.upper(F.substring(F.md5(F.regexp_replace(key, "-OLD$", "")), 1, 6))).alias("customer_sku"), "item_code"
    )
    valid = base.withColumns({"valid_from": F.lit(""), "valid_to": F.lit(""), "confidence": F.lit("1.0"), "source": F.lit("confirmed_order")})
    other = F.lead("item_code").over(Window.partitionBy("tenant").orderBy("customer_sku", "item_code"))
    expired = base.withColumn("item_code", other).where("item_code IS NOT NULL").where(chance(F.col("customer_sku"), "collides") < 0.1)
    return valid.unionByName(expired.withColumns({"valid_from": F.lit(""), "valid_to": F.lit("2026-03-31"), "confidence": F.lit("0.8"), "source": F.lit("inferred_match")}))


def noisy_lines(items: DataFrame, n_kinds: int = 9) -> DataFrame:
    """One line for each item, in a way of writing that goes by turns."""
    key, name = F.col("item_code"), F.col("item_name")
    kind = F.pmod(F.xxhash64(key), F.lit(n_kinds))
    ways = (name, typo(name, key), case(name, key), abbreviate(name), translate(name), drop_words(name, key), pack_suffix(name, key), noise_prefix(name, key), punctuate(name, key))
    raw = F.lit(None).cast("string")
    for k, way in enumerate(ways):
        raw = F.when(kind == k, way).otherwise(raw)
    return items.select("tenant", key.alias("gt_item_code"), kind.cast("int").alias("kind"), raw.alias("raw_text"))


def catalogue(spark: SparkSession, tenant: str, brands: list[str], axes: list[tuple[list[str], list[str]]], n: int) -> DataFrame:
    """The first ``n`` products of brands and axes in an order by hash; some superseded, some with a bulk twin, some not items at all."""
    brand = spark.createDataFrame([(x,) for x in brands], "brand string")
    first = spark.createDataFrame([(x,) for a, _ in axes for x in a], "kind string")
    second = spark.createDataFrame([(x,) for _, b in axes for x in b], "size string")
    # lists of a few words: their product is the catalogue
    named = brand.join(first).join(second).distinct().withColumn("item_name", F.concat_ws(" ", "brand", "kind", "size"))
    base = named.orderBy(F.xxhash64("item_name"), "item_name").limit(n).select(
        F.lit(tenant).alias("tenant"), F.upper(F.concat(F.substring(F.lit(tenant), 1, 3), F.lit("-"), F.substring(F.md5("item_name"), 1, 8))).alias("item_code"), "item_name", "brand", F.lit("0").alias("disabled")
    )
    turn = F.pmod(F.xxhash64("item_code", F.lit("twin")), F.lit(40))
    old = base.where(turn == 0).withColumns({"item_code": F.concat("item_code", F.lit("-OLD")), "disabled": F.lit("1")})
    bulk = base.where(turn == 1).withColumns({"item_code": F.concat("item_code", F.lit("B")), "item_name": F.concat("item_name", F.lit(" (Bulk)"))})
    junk = spark.createDataFrame([(tenant, f"{tenant[:3].upper()}-MISC{k}", name, "", "0") for k, name in enumerate(("Delivery Fee", "Handling Charge", "Sample Item"))], "tenant string, item_code string, item_name string, brand string, disabled string")
    return base.unionByName(old).unionByName(bulk).unionByName(junk)


def ledger(spark: SparkSession, lines: int, tenants: int = 40, items: int = 1200, days: int = 61, seed: int = 1) -> dict[str, DataFrame]:
    """A ledger whose tenants differ much in size, as the report's benchmark needs it: about nine events a line."""
    plans = F.array(F.lit("starter"), F.lit("growth"), F.lit("enterprise"))
    tenant = spark.range(tenants).select(F.col("id").cast("int").alias("tenant_id"), F.concat(F.lit("Tenant "), F.col("id").cast("string")).alias("name"), F.get(plans, (F.col("id") % 3).cast("int")).alias("plan"))
    key, salt = F.col("id"), str(seed)
    skewed = F.floor(F.pow(chance(key, f"{salt}-tenant"), 2.0) * tenants).cast("int")
    channel = F.get(F.array(*(F.lit(x) for x in ("whatsapp", "email_pdf", "portal_csv", "voice_note"))), pick(key, f"{salt}-channel", 4))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(pick(key, f"{salt}-day", days), F.lit(0), F.lit(0), pick(key, f"{salt}-second", 86400).cast("decimal(18,6)"))
    order_line = spark.range(lines).select(key.alias("line_id"), skewed.alias("tenant_id"), pick(key, f"{salt}-customer", 500).cast("long").alias("customer_id"), channel.alias("channel"), at.alias("created_at"))
    number = order_line.withColumn("rank", F.explode(F.sequence(F.lit(1), pick(F.col("line_id"), f"{salt}-n", 14) + 3)))
    event = (F.col("line_id") * 20 + F.col("rank")).alias("event_id")
    latency = F.ceil(F.exp(F.lit(4.0) + F.lit(0.9) * F.sqrt(-2.0 * F.log(chance(F.col("line_id") * 20 + F.col("rank"), f"{salt}-u") + 1e-9)) * F.cos(6.283185307179586 * chance(F.col("line_id") * 20 + F.col("rank"), f"{salt}-v"))))
    match_event = number.select(
        event, "line_id", "tenant_id", pick(F.col("line_id") * 20 + F.col("rank"), f"{salt}-item", items).alias("item_code"), (pick(F.col("line_id") * 20 + F.col("rank"), f"{salt}-score", 64) / F.lit(64.0)).alias("score"),
        F.col("rank").cast("int").alias("rank"), ((F.col("rank") == 1) & (chance(F.col("line_id"), f"{salt}-accept") < 0.72)).alias("accepted"), latency.cast("long").alias("latency_ms"), "created_at",
    )
    item = tenant.select("tenant_id", F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("item_code")).withColumn("disabled", F.pmod(F.xxhash64("tenant_id", "item_code"), F.lit(16)) == 0)
    return {"tenant": tenant, "order_line": order_line, "match_event": match_event, "item": item}
