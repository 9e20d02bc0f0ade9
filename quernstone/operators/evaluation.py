"""Metrics over labelled decisions.

All programs read the same table of decisions (``matching.decide``); each is
one aggregation over it, or over its product with a small constant grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRONG = ("barcode", "alias", "barcode+alias")
# The grids and costs of the reports.
SWEEP_SCORES, SWEEP_MARGINS = (0.85, 0.90, 0.925, 0.95, 0.97, 0.98), (0.00, 0.01, 0.03, 0.05, 0.10)
SCORE_BOUNDS = (0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90)
BANDS = ((0.95, 0.10), (0.90, 0.10), (0.85, 0.10), (0.85, 0.05), (0.85, 0.03))
COST_CORRECT, COST_ABSTAIN, COST_WRONG = -20, 40, 800


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def positive() -> Column:
    return F.trim("gt_item_code") != ""


def correct() -> Column:
    return positive() & F.col("item_code").eqNullSafe(F.col("gt_item_code"))


def codes(limit: int | None = None) -> Column:
    got = F.transform("candidates", lambda x: x["item_code"])
    return F.slice(got, 1, limit) if limit else got


def counts() -> dict[str, Column]:
    auto, review, none = (F.col("decision") == x for x in ("auto", "review", "no_match"))
    return {
        "rows": F.count(F.lit(1)),
        "positive_gt": F.count_if(positive()),
        "blank_gt": F.count_if(~positive()),
        "auto": F.count_if(auto),
        "auto_correct": F.count_if(auto & correct()),
        "auto_wrong": F.count_if(auto & ~correct()),
        "review": F.count_if(review),
        "no_match": F.count_if(none),
    }


def by_group(decided: DataFrame, *keys: str) -> DataFrame:
    """Counts, precision and coverage of each group."""
    return shares(decided.groupBy(*keys).agg(*(c.alias(name) for name, c in counts().items())))


def shares(out: DataFrame) -> DataFrame:
    """Counts with precision and coverage."""
    return out.withColumns({"precision": ratio(F.col("auto_correct"), F.col("auto")), "coverage": ratio(F.col("auto"), F.col("rows"))})


def summary(judged: DataFrame) -> DataFrame:
    """One row of all main metrics; hits count among the first five fuzzy candidates of every labelled line."""
    auto, review, none = (F.col("decision") == x for x in ("auto", "review", "no_match"))
    strong = F.col("source").isin(*STRONG)

    def hits(most: int):
        found = F.size(F.filter(F.slice("fuzzy_five", 1, most), lambda x: x == F.col("gt_item_code")))
        return F.coalesce(F.sum(F.when(positive() & F.col("fuzzy").isNotNull(), found).cast("long")), F.lit(0))

    main = judged.agg(
        *(c.alias(name) for name, c in counts().items()),
        F.count_if(review & positive()).alias("review_positive"),
        F.count_if(review & ~positive()).alias("review_blank"),
        F.count_if(none & ~positive()).alias("no_match_correct"),
        F.count_if(none & positive()).alias("no_match_wrong"),
        F.count_if(strong).alias("strong_total"),
        F.count_if(strong & correct()).alias("strong_correct"),
        hits(1).alias("top1_correct"),
        hits(5).alias("top5_correct"),
    )
    return main.withColumns(
        {
            "auto_precision": ratio(F.col("auto_correct"), F.col("auto")),
            "auto_coverage": ratio(F.col("auto"), F.col("rows")),
            "no_match_precision": ratio(F.col("no_match_correct"), F.col("no_match")),
            "no_match_blank_recall": ratio(F.col("no_match_correct"), F.col("blank_gt")),
            "top1_accuracy": ratio(F.col("top1_correct"), F.col("positive_gt")),
            "top5_recall": ratio(F.col("top5_correct"), F.col("positive_gt")),
            "strong_precision": ratio(F.col("strong_correct"), F.col("strong_total")),
            "relative_cost": 20 * F.col("auto_wrong") + F.col("review") + F.col("no_match"),
        }
    )


def by_tag(decided: DataFrame, tags: DataFrame) -> DataFrame:
    """Metrics of each noise tag; a line counts for all its tags."""
    return of_tags(decided.join(tags.select("line_id", "tags"), "line_id"), ("tags",), F.col("tags"))


def of_tags(decided: DataFrame, keys: tuple[str, ...], tags: Column) -> DataFrame:
    """Metrics of each noise tag of decided lines: those of the same keys, which say their tags, are counted first, then counts for each tag."""
    same = decided.groupBy(*keys).agg(*(c.alias(name) for name, c in counts().items()))
    out = same.select(F.explode(tags).alias("tag"), *counts()).groupBy("tag").agg(*(F.sum(name).alias(name) for name in counts()))
    return shares(out)


def sweep(judged: DataFrame) -> DataFrame:
    """Decisions at every pair of thresholds; identifier conflicts fall to the fuzzy lane, and a single candidate has margin 0."""
    grid = judged.sparkSession.createDataFrame([(s, m) for s in SWEEP_SCORES for m in SWEEP_MARGINS], "score_threshold double, margin_threshold double")
    strong = F.when(F.col("source").isin(*STRONG), F.col("item_code"))
    gap = F.when(F.size("fuzzy_candidates") > 1, F.col("fuzzy_margin")).when(F.col("fuzzy_candidates").isNotNull(), 0.0)
    rows = judged.select("line_id", "gt_item_code", strong.alias("strong"), "fuzzy", F.col("fuzzy_confidence").alias("score"), gap.alias("gap"))
    each = rows.join(F.broadcast(grid))  # a grid of 30 cells
    by_score = F.col("strong").isNull() & (F.col("score") >= F.col("score_threshold")) & (F.col("gap") >= F.col("margin_threshold"))
    chosen = F.coalesce("strong", F.when(by_score, F.col("fuzzy")))
    right = positive() & (F.col("chosen") == F.col("gt_item_code"))
    picked = each.withColumns({"chosen": chosen, "by_score": by_score})
    out = picked.groupBy("score_threshold", "margin_threshold").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("chosen").isNotNull()).alias("auto"),
        F.count_if(F.col("chosen").isNotNull() & right).alias("correct"),
        F.count_if(F.col("strong").isNotNull()).alias("strong"),
        F.count_if(F.col("by_score")).alias("lexical"),
    )
    return out.select("score_threshold", "margin_threshold", "auto", "correct", (F.col("auto") - F.col("correct")).alias("wrong"), "strong", "lexical", ratio(F.col("correct"), F.col("auto")).alias("precision"), (F.col("auto") / F.col("rows")).alias("coverage"))


def score_distribution(lexical: DataFrame) -> DataFrame:
    """How many labelled and blank lines reach each bound, and how many stay below."""
    grid = lexical.sparkSession.createDataFrame([(x,) for x in SCORE_BOUNDS], "threshold double")
    rows = lexical.select("gt_item_code", "confidence").join(F.broadcast(grid))
    above = F.col("confidence") >= F.col("threshold")
    return rows.groupBy("threshold").agg(
        F.count_if(above & positive()).alias("positive_reached"), F.count_if(above & ~positive()).alias("blank_reached"), F.count_if(~above & positive()).alias("positive_below"), F.count_if(~above & ~positive()).alias("blank_below")
    )


def blank_bands(lexical: DataFrame) -> DataFrame:
    """Blank lines that reach each band of score and margin together, or the margin alone."""
    grid = lexical.sparkSession.createDataFrame(list(BANDS), "low_score double, low_margin double")
    rows = lexical.where(~positive()).select("confidence", "margin").join(F.broadcast(grid))
    wide = F.col("margin") >= F.col("low_margin")
    return rows.groupBy("low_score", "low_margin").agg(F.count_if(wide & (F.col("confidence") >= F.col("low_score"))).alias("n_band"), F.count_if(wide).alias("n_margin"))


def rank_buckets(ranked: DataFrame, lines: DataFrame) -> DataFrame:
    """Where labelled lines' items stand among their candidates."""
    place = ranked.where(F.col("item_code") == F.col("gt_item_code")).groupBy("line_id").agg(F.min("rank").alias("gt_rank"))
    rows, r = lines.where(positive()).join(place, "line_id", "left"), F.col("gt_rank")
    return rows.agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(r == 1).alias("first"), F.count_if(r == 2).alias("second"), F.count_if(r <= 3).alias("within_3"), F.count_if(r <= 5).alias("within_5"), F.count_if(r <= 20).alias("within_20"), F.count_if(r.isNull()).alias("missing")
    )


def holdout_score(decided: DataFrame) -> DataFrame:
    """Precision, coverage, right abstentions, recall among three candidates when abstaining, and costs."""
    auto = F.col("decision") == "auto"
    # of ``judged`` the codes come from the ask; no candidates cross the network with the lines
    three = F.when(F.col("source") == "lexical", F.slice("fuzzy_five", 1, 3)) if "fuzzy_five" in decided.columns else codes(3)
    out = decided.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(auto).alias("n_auto"),
        F.count_if(auto & correct()).alias("n_correct"),
        F.count_if(auto & ~correct()).alias("n_wrong"),
        F.count_if(~auto).alias("n_abstained"),
        F.count_if(~positive()).alias("abstain_should"),
        F.count_if(~positive() & ~auto).alias("abstain_right"),
        F.count_if(~auto & positive()).alias("recall3_total"),
        F.count_if(~auto & positive() & F.array_contains(three, F.col("gt_item_code"))).alias("recall3_hits"),
        F.sum(F.when(auto & correct(), COST_CORRECT).when(auto, COST_WRONG).otherwise(COST_ABSTAIN)).alias("cost"),
        (COST_ABSTAIN * F.count(F.lit(1))).alias("cost_abstain_all"),
        F.sum(F.when(positive(), COST_CORRECT).otherwise(COST_ABSTAIN)).alias("cost_oracle"),
    )
    return out.withColumns(
        {"precision": ratio(F.col("n_correct"), F.col("n_auto")), "coverage": ratio(F.col("n_auto"), F.col("n_lines")), "abstain_share": ratio(F.col("abstain_right"), F.col("abstain_should")), "recall3": ratio(F.col("recall3_hits"), F.col("recall3_total"))}
    )


def class_tenant_breakdown(decided: DataFrame) -> DataFrame:
    """Lines, AUTO and right AUTO by class of label and by tenant, in one pass."""
    auto = F.col("decision") == "auto"
    both = decided.groupBy(F.when(positive(), "match").otherwise("abstain").alias("class"), "tenant").agg(F.count(F.lit(1)).alias("n"), F.count_if(auto).alias("auto"), F.count_if(auto & correct()).alias("auto_correct"))
    # few rows are left to stand for their class and for their tenant
    each = both.select("n", "auto", "auto_correct", F.explode(F.array(*(F.struct(F.lit(x).alias("grouping"), F.col(x).alias("name")) for x in ("class", "tenant")))).alias("g"))
    return each.groupBy("g.grouping", "g.name").agg(*(F.sum(x).alias(x) for x in ("n", "auto", "auto_correct")))


def identifier_diagnosis(judged: DataFrame) -> DataFrame:
    """For labelled lines whose fuzzy best is wrong: what the identifier lanes say of them."""
    rows = judged.where(positive() & (F.col("fuzzy") != F.col("gt_item_code")))
    label = F.when(F.col("source") == "identifier_conflict", "identifier_conflict").when(F.col("source").isin(*STRONG) & correct(), "identifier_correct").when(F.col("source").isin(*STRONG), "identifier_wrong").otherwise("true_lexical_error")
    return rows.groupBy(label.alias("diagnosis")).agg(F.count(F.lit(1)).alias("n"))


def auto_errors(decided: DataFrame) -> DataFrame:
    """Lines decided automatically and wrongly."""
    return decided.where((F.col("decision") == "auto") & ~correct()).select("line_id", "tenant", "source", "item_code", "gt_item_code", "confidence")


def no_match_errors(decided: DataFrame) -> DataFrame:
    """Labelled lines that were given up."""
    return decided.where((F.col("decision") == "no_match") & positive()).select("line_id", "tenant", "gt_item_code", "confidence")


def hits(ranked: Column, most: int | None = None) -> Column:
    """The candidates, or the first ``most``, that are the label's item."""
    return F.filter(F.slice(ranked, 1, most) if most else ranked, lambda x: x["item_code"] == F.col("gt_item_code"))


def retrieval_scores(listed: DataFrame) -> DataFrame:
    """Top-1 and top-5 hits and the mean score of right and wrong firsts."""
    first = F.col("ranked")[0]
    hit, score = first["item_code"] == F.col("gt_item_code"), first["confidence_score"]
    return listed.where(positive() & F.col("ranked").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(hit).alias("top1"), F.coalesce(F.sum(F.size(hits(F.col("ranked"), 5)).cast("long")), F.lit(0)).alias("top5"), F.avg(F.when(hit, score)).alias("avg_score_right"), F.avg(F.when(~hit, score)).alias("avg_score_wrong")
    )


def retrieval_misses(listed: DataFrame) -> DataFrame:
    """Labelled lines whose item is not the first candidate: what is, and where the item stands (null if nowhere)."""
    place = F.nullif(F.array_position(F.transform("ranked", lambda x: x["item_code"]), F.col("gt_item_code")), F.lit(0)).cast("int")
    rows = listed.where(positive()).select("line_id", "gt_item_code", F.col("ranked")[0]["item_code"].alias("first_code"), place.alias("gt_rank"))
    return rows.where(~F.col("gt_rank").eqNullSafe(1))


def blank_candidates(lexical: DataFrame) -> DataFrame:
    """For lines without an item: their first two candidates, score and margin."""
    rows = lexical.where(~positive())
    second = F.get(F.transform("candidates", lambda x: x["item_code"]), F.lit(1))
    return rows.select("line_id", "item_code", second.alias("second_code"), "confidence", "margin")


def blank_examples(lexical: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` lines without an item whose score, then margin, is lowest."""
    return lexical.where(~positive()).orderBy("confidence", "margin", "line_id").limit(n).select("line_id", "raw_text", "confidence", "margin")


def own_items(catalogue: DataFrame) -> DataFrame:
    """tenant, gt_item_code, gt_name, gt_price: what labels stand for."""
    return catalogue.select("tenant", F.col("item_code").alias("gt_item_code"), F.col("item_name").alias("gt_name"), F.col("list_price").alias("gt_price"))


def failure_drilldown(lines: DataFrame, asks: DataFrame, catalogue: DataFrame, key: tuple[str, ...], n: int = 5) -> DataFrame:
    """The first ``n`` candidates of labelled lines whose item is not the first of them, beside the label's own item.

    ``lines`` have their ask's key and ``own_items`` of their label; ``asks`` have the key, tenant, raw_text and ``ranked``.
    """
    named = catalogue.select("tenant", "item_code", "item_name", "list_price")
    # names are found once for each ask
    each = asks.select(*key, "tenant", "raw_text", F.inline(F.slice("ranked", 1, n))).drop("list_price").join(named, ["tenant", "item_code"])
    shown = each.groupBy(*key, "raw_text").agg(F.min_by("item_code", "rank").alias("first_code"), F.collect_list(F.struct("rank", "item_code", "item_name", "list_price", "lexical_score", "rank_score")).alias("shown"))
    rows = lines.where(positive()).join(shown, list(key))
    return rows.where(F.col("first_code") != F.col("gt_item_code")).select("line_id", "raw_text", "gt_item_code", "gt_name", "gt_price", F.inline("shown"))


def price_examples(listed: DataFrame, gap: float = 0.10) -> DataFrame:
    """Wrong firsts whose price is further from the line's than the right candidate's, by more than ``gap``."""
    price, first = F.col("unit_price").try_cast("double"), F.col("ranked")[0]
    rows = listed.where(positive() & (price > 0) & (first["list_price"] > 0) & (first["item_code"] != F.col("gt_item_code")))
    each = rows.select("line_id", first["item_code"].alias("first_code"), "gt_item_code", price.alias("price"), first["list_price"].alias("first_price"), F.explode(F.transform(hits(F.col("ranked")), lambda x: x["list_price"])).alias("gt_listed")).where("gt_listed > 0")
    off = {name: F.abs(F.col("price") - F.col(c)) / F.col(c) for name, c in (("first_off", "first_price"), ("gt_off", "gt_listed"))}
    return each.withColumns(off).where(F.col("gt_off") + gap < F.col("first_off")).select("line_id", "first_code", "gt_item_code", "first_off", "gt_off")


def confident_uom_pairs(ranked: DataFrame, lines: DataFrame, reference: DataFrame, least: float = 0.95, gap: float = 0.08) -> DataFrame:
    """Of lines whose best candidate by text is sure and far ahead: how often an order's unit meets each unit of it."""
    best = ranked.groupBy("line_id", "tenant").agg(
        F.max_by("item_code", F.when(F.col("lex_rank") == 1, 1)).alias("item_code"), F.max(F.when(F.col("lex_rank") == 1, F.col("lexical_score"))).alias("one"), F.max(F.when(F.col("lex_rank") == 2, F.col("lexical_score"))).alias("two")
    )
    sure = best.where((F.col("one") >= least) & (F.col("one") - F.coalesce("two", F.lit(0.0)) >= gap)).select("line_id", "tenant", "item_code")
    units = reference.select("tenant", "item_code", F.col("uom").alias("item_uom")).distinct()
    asked = lines.where(F.trim("uom_text") != "").select("line_id", "uom_text")
    return sure.join(asked, "line_id").join(units, ["tenant", "item_code"]).groupBy("uom_text", "item_uom").agg(F.count(F.lit(1)).alias("n"))


def price_signal(listed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """How far lines' prices lie from their items': medians and shares, overall and by whether the first candidate is right."""
    first = listed.where("ranked IS NOT NULL").select("line_id", "tenant", "gt_item_code", "unit_price", (F.col("ranked")[0]["item_code"] == F.col("gt_item_code")).alias("right"))
    prices = catalogue.select("tenant", F.col("item_code").alias("gt_item_code"), "list_price").where("list_price > 0")
    price = F.col("unit_price").try_cast("double")
    rows = first.where(positive() & (price > 0)).join(prices, ["tenant", "gt_item_code"]).withColumn("off", F.abs(price - F.col("list_price")) / F.col("list_price"))
    groups = rows.select("off", F.explode(F.array(F.lit("all"), F.when(F.col("right"), "first_right").otherwise("first_wrong"))).alias("outcome"))
    return groups.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("off", 0.5).alias("median_off"), *(F.count_if(F.col("off") <= b / 100).alias(f"within_{b}") for b in (10, 25, 50))
    )


def latency_percentiles(events: DataFrame) -> DataFrame:
    """Mean and nearest-rank percentiles of latency."""
    disc = {p: F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias(f"p{p}_ms") for p in (50, 95, 99)}
    return events.agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_ms"), *disc.values(), F.max("latency_ms").alias("max_ms"))
