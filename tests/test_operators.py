"""Operators on hand-made tables: lanes, decisions, report forms, validation, files, health."""

from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quernstone import schemas
from quernstone.operators import evaluation, health, identifiers, matching, report, validate
from quernstone.sources import files, models

ITEM = "tenant string, item_code string, item_name string, brand string, disabled string, list_price double, barcode string, _row_ord long"
LINE = "line_id long, tenant string, customer_id string, order_date string, raw_text string, unit_price string, buyer_sku string, raw_barcode string, uom_text string, gt_item_code string"
ALIAS = "tenant string, customer_id string, customer_sku string, item_code string, valid_from string, valid_to string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            ("t", "A", "Bosco Ball Valve 2in PVC", "Bosco", "0", 10.0, "111", 1),
            ("t", "B", "Hitex Hex Bolt m8x75", "Hitex", "0", 5.0, "222", 2),
            ("t", "C", "Hitex Hex Bolt m8x75", "Hitex", "0", 5.0, "222", 3),
            ("t", "D-OLD", "Flap Disc 100mm", "Kanto", "1", 3.0, "333", 4),
            ("t", "D", "Flap Disc 100mm", "Kanto", "0", 3.0, "", 5),
            ("t", "E-OLD", "Grinding Disc 100mm", "Kanto", "1", 3.0, "", 6),
            ("u", "A2", "Bosco Ball Valve 2in PVC", "Bosco", "0", 10.0, "111", 7),
        ],
        ITEM,
    )


def line(k, text="x", sku="", barcode="", tenant="t", date="2024-05-05", price=None, gt=""):
    return (k, tenant, "c", date, text, price, sku, barcode, "", gt)


def test_lanes(spark, items):
    aliases = spark.createDataFrame(
        [
            ("t", "c", "s1", "A", "2024-01-01", ""), ("t", "c", "s2", "D-OLD", "", ""), ("t", "c", "s3", "A", "", "2024-01-01"), ("t", "c", "s4", "A", "", ""), ("t", "c", "s4", "B", "", ""),
            ("t", "c", "s5", "E-OLD", "", ""), ("t", "c", "s6", "A", "", ""), ("t", "c", "s6", "A", "", "2030-01-01"), ("t", "other", "s7", "A", "", ""),
        ],
        ALIAS,
    )
    lines = spark.createDataFrame(
        [
            line(1, sku="s1"), line(2, sku="s2"), line(3, sku="s3"), line(4, sku="s4"), line(5, sku="s5"), line(6, sku="s6"), line(7, sku="s7"), line(8, barcode="111"), line(9, barcode="222"),
            line(10, barcode="333"), line(11, sku="s1", barcode="111"), line(12, sku="s2", barcode="111"), line(13, barcode=" 111 "), line(14, barcode="  "),
        ],
        LINE,
    )
    got = {r.line_id: (r.source, r.decision, r.item_code) for r in identifiers.arbitrate(lines, aliases, items).collect()}
    assert got == {
        1: ("alias", "auto", "A"), 2: ("alias", "auto", "D"), 6: ("alias", "auto", "A"), 8: ("barcode", "auto", "A"), 11: ("barcode+alias", "auto", "A"),
        12: ("identifier_conflict", "review", None), 13: ("barcode", "auto", "A"),
    }


def test_ranking_and_decisions(spark, items):
    lines = spark.createDataFrame([line(1, 'Bosco Ball Valve 2" PVC', price="10.2", gt="A"), line(2, "hex bolt m8x75", gt="B"), line(3, "kanto flap disc 100mm", gt="D"), line(4, "delivery by friday"), line(5, "", gt="A")], LINE)
    ranked = matching.rank_candidates(lines, items)
    first = {r.line_id: r for r in ranked.where("rank = 1").collect()}
    assert (first[1].item_code, first[1].brand_match, first[1].price_score) == ("A", 1.0, 1.0)
    assert first[2].item_code == "B"  # a tie with C keeps the catalogue's order
    assert first[3].item_code == "D"
    assert ranked.where("confidence_score > 0.9000001").isEmpty()
    decided = matching.decide(lines, items, spark.createDataFrame([], ALIAS))
    got = {r.line_id: r.decision for r in decided.collect()}
    assert got[1] == "auto" and got[2] == "review" and got[4] == "no_match" and got[5] == "no_match"
    out = matching.predictions(decided)
    assert validate.prediction_violations(out, lines).isEmpty()
    assert {r.line_id: r.reason_code for r in out.collect()}["1"] == "lexical_unique"


def test_no_item_of_another_tenant(spark, sf_dir):
    lines, items = models.line(spark, sf_dir), models.catalogue(spark, sf_dir)
    ranked = matching.rank_candidates(lines, items, 5, 5).select("line_id", "tenant", "item_code")
    assert ranked.join(items.select("tenant", "item_code"), ["tenant", "item_code"], "left_anti").isEmpty()


def test_limits_change_results_only_beyond_them(spark, sf_dir):
    lines, items = models.line(spark, sf_dir), models.catalogue(spark, sf_dir)
    wide, narrow = (matching.retrieve(matching.prepared_lines(lines), matching.prepared_items(items), n).where("lex_rank <= 5") for n in (30, 5))
    assert rows_of(wide) == rows_of(narrow)


def test_price_score(spark):
    rows = spark.createDataFrame([("10", 10.0), ("12", 10.0), ("14", 10.0), ("30", 10.0), ("nan", 10.0), ("1d", 10.0), ("-3", 10.0), (None, 10.0), ("10", 0.0)], "p string, l double")
    assert [r.s for r in rows.select(matching.price_score(F.col("p"), F.col("l")).alias("s")).collect()] == [1.0, 0.8, 0.5, 0.0, 0.5, 0.5, 0.5, 0.5, 0.5]


def test_report_forms_agree(spark, sf_dir):
    ledger = models.ledger(spark, sf_dir)
    whole = report.tenant_health(ledger, models.FIRST_DAY, models.LAST_DAY)
    assert rows_of(whole.drop("p95_latency_ms")) == rows_of(report.correlated(spark, ledger, models.FIRST_DAY, models.LAST_DAY))
    assert validate.same_rows(report.p95_window(ledger, models.FIRST_DAY, models.LAST_DAY), report.p95_aggregate(ledger, models.FIRST_DAY, models.LAST_DAY))
    part = files.report_slice(ledger, models.FIRST_DAY, models.LAST_DAY)
    assert validate.same_rows(whole, report.tenant_health(part, models.FIRST_DAY, models.LAST_DAY))


def test_report_without_events(spark, sf_dir):
    ledger = models.ledger(spark, sf_dir)
    ledger["match_event"] = ledger["match_event"].limit(0)
    row = report.tenant_health(ledger, models.FIRST_DAY, models.LAST_DAY).first()
    assert (row.lines_accepted, row.candidates_considered, row.repeat_items_prev_day, row.accepted_disabled) == (0, 0, 0, 0)
    assert row.avg_accept_score is None and row.p95_latency_ms is None


def test_different_rows_counts_repeats(spark):
    a, b = spark.createDataFrame([(1, 0.1), (1, 0.1)], "k int, v double"), spark.createDataFrame([(1, 0.10000001)], "k int, v double")
    assert validate.different_rows(a, b).count() == 1 and validate.same_rows(a, a)


def test_violations(spark):
    rows = spark.createDataFrame(
        [("1", "A", "0.9", "auto", "x", "A:0.9"), ("1", "", "0.9", "review", "x", ""), ("2", "", "nan", "auto", "", "A:2|B"), ("9", "", "0.1", "reject", "x", "")], schemas.PREDICTIONS
    )
    lines = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "t")], "line_id string, tenant string")
    got = sorted(map(tuple, validate.prediction_violations(rows, lines, F.lit("B")).collect()))
    assert got == sorted(
        [("1", "duplicate_line"), ("1", "duplicate_line"), ("1", "foreign_item"), ("2", "auto_without_item"), ("2", "bad_candidate"), ("2", "bad_confidence"), ("2", "blank_reason"), ("2", "foreign_item"), ("3", "missing_line"), ("9", "unknown_line")]
    )


def test_csv_keeps_quotes_and_blanks(spark, tmp_path):
    path = tmp_path / "items.csv"
    header = ",".join(schemas.CATALOGUE.names)
    path.write_text("﻿" + header + '\nA,"Ball ""2"" valve, long",,Bosco,g,pcs,"[{""uom"": ""ctn"", ""conversion_factor"": 12}]",,,0,1,2.5\n', encoding="utf-8")
    rows = files.read_catalogues(spark, {"acme": str(path)})
    row = rows.first()
    assert (row.item_code, row.item_name, row.description, row.tenant) == ("A", 'Ball "2" valve, long', "", "acme")
    assert [tuple(r) for r in health.uom_reference(rows).collect()] == [("acme", "A", "ctn", 12.0, 0)]
    files.write_csv(rows, f"{tmp_path}/out", ["item_code", "item_name", "description"])
    again = files.read_csv(spark, f"{tmp_path}/out", schemas.strings("item_code", "item_name", "description")).first()
    assert tuple(again) == ("A", 'Ball "2" valve, long', "")


def test_ledger_files_and_copies(spark, sf_dir, tmp_path):
    ledger = models.ledger(spark, sf_dir)
    files.write_ledger(ledger, f"{tmp_path}/ledger")
    back = {k: spark.read.parquet(f"{tmp_path}/ledger/{k}") for k in ledger}
    first = report.tenant_health(ledger, models.FIRST_DAY, models.LAST_DAY)
    assert validate.same_rows(first, report.tenant_health(back, models.FIRST_DAY, models.LAST_DAY))
    assert files.copy_rows(ledger["tenant"], f"{tmp_path}/copy", F.col("plan") == "growth") == ledger["tenant"].where("plan = 'growth'").count()
    files.write_json_result(ledger["tenant"], f"{tmp_path}/json")
    assert files.read_json_result(spark, f"{tmp_path}/json").count() == ledger["tenant"].count()
    assert '"columns": ["tenant_id"' in files.result_document(ledger["tenant"], 0.1)
    ledger["tenant"].createOrReplaceTempView("tenant_view")
    assert files.relation(spark, "SELECT * FROM tenant_view WHERE plan = :p", args={"p": "starter"}).count() > 0
    assert files.table_columns(spark).where("table_name = 'tenant_view'").count() == 3


def test_evaluation_of_nothing(spark):
    empty = spark.createDataFrame([], "line_id long, tenant string, gt_item_code string, source string, decision string, item_code string, confidence double, margin double, candidates array<struct<rank:int,item_code:string,score:double,lexical:double>>")
    row = evaluation.holdout_score(empty).first()
    assert row.n_lines == 0 and row.precision == 0.0
    assert evaluation.by_group(empty, "tenant").isEmpty()


def test_ambiguous_lines(spark, items):
    lines = spark.createDataFrame([line(1, "hex bolt"), line(2, "ball valve"), line(3, "no such words"), line(4, "")], LINE)
    assert [tuple(r) for r in health.ambiguous_lines(lines, items).collect()] == [(1, 2)]


def test_latest_by_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], "k int, v int, t string")
    assert sorted(map(tuple, health.latest_by_key(rows, "k", "v").collect())) == [(1, 3, "c"), (2, 1, "x")]

def test_lines_of_twelve_classes(spark):
    from quernstone.operators import generators

    items = generators.catalogue(spark, "alpha", ["Remax", "Bosco"], [(["Hex Bolt", "Wall Plug"], ["8mm", "Stainless 304"])], 8).withColumn("barcode", F.concat(F.lit("9"), F.abs(F.xxhash64("item_code")).cast("string")))
    lines = generators.order_lines(items, generators.derived_aliases(items), 950)
    rows = lines.collect()
    assert len(rows) == 950
    counts = {}
    for r in rows:
        counts[r.gt_class] = counts.get(r.gt_class, 0) + 1
        assert (r.gt_item_code == "") == (r.gt_class in ("ambiguous", "absent", "junk"))
        assert r.raw_text
    assert counts == {k: 10 * v for k, v in generators.CLASSES.items()}
    assert [tuple(r) for r in lines.orderBy("line_id").collect()] == [tuple(r) for r in generators.order_lines(items, generators.derived_aliases(items), 950).orderBy("line_id").collect()]
