"""Text functions and similarities on published and hand-made cases."""

from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import similarity, text

NORMALISED = [
    ('Bosco Ball Valve 2" PVC', "bosco ball valve 2in pvc", {"2in"}),
    ('Bosco Ball Valve 1/2" PVC', "bosco ball valve 1/2in pvc", {"1/2in"}),
    ("Hitex/Ball/Valve/3/4''/SS304", "hitex ball valve 3/4in stainless 304", {"3/4in", "304"}),
    ("remax - hex - bolt - m8x75 - ZP", "remax hex bolt m8x75 zinc plated", {"8", "75"}),
    ("Stallion Hose Clip 25-38mm Zinc", "stallion hose clip 25-38mm zinc", {"25", "38"}),
    ("pls send Kanto Masking Tape 24Mm General", "kanto masking tape 24mm general", {"24"}),
    ("Bosco Cable Tie 300mm putih", "bosco cable tie 300mm white", {"300"}),
    ('Remax Ball Valve " 1PVC', "remax ball valve 1in pvc", {"1in"}),
    (None, "", set()),
    ("  ", "", set()),
    ("order item x", "item x", set()),
]


def test_normalize_and_numbers(spark):
    rows = spark.createDataFrame([(k, x) for k, (x, _, _) in enumerate(NORMALISED)], "k int, t string")
    got = rows.select("k", text.normalize_text(F.col("t")).alias("n"), text.extract_numbers(F.col("t")).alias("s")).orderBy("k").collect()
    assert [(r.n, set(r.s)) for r in got] == [(n, s) for _, n, s in NORMALISED]


def test_unicode_form(spark):
    rows = spark.createDataFrame([("ﬁtting １２ ｍｍ",), (None,)], "t string")
    assert [r.n for r in rows.select(text.normalize_text(F.col("t")).alias("n")).collect()] == ["fitting 12 mm", ""]


def test_block_equals_pairs():
    import random

    rng = random.Random(4)
    words = ["brand#12", "ivory", "steel", "economy", "32mm", "a", "bb", "1/2in", "caf\u00e9", "averyveryverylongword", "anothermuchtoolongword"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(300)]
    block = similarity.TokenBlock(texts)
    for _ in range(40):
        query = " ".join(rng.choices([*words, "zz", "unknown"], k=rng.randint(0, 8)))
        assert block.ratios(query).tolist() == similarity.token_set_ratios([sorted(set(query.split()))] * len(texts), [sorted(set(x.split())) for x in texts]).tolist()


@pytest.mark.parametrize("method", sorted(similarity.SCORERS))
def test_block_of_every_scorer(method):
    import random

    rng = random.Random(5)
    words = ["brand#12", "ivory", "steel", "32mm", "a", "1/2in", "averyveryverylongword", "anothermuchtoolongword"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(60)]
    block = similarity.RatioBlock(texts, method)
    for _ in range(10):
        query = " ".join(rng.choices([*words, "zz"], k=rng.randint(0, 5)))
        assert block.ratios(query).tolist() == pytest.approx(similarity.SCORERS[method]([query] * len(texts), texts).tolist())


def test_variant_has_an_order(spark):
    rows = spark.createDataFrame([("Grinding flap disc",), ("cutting and grinding",), ("disc",), (None,)], "t string")
    assert [r.v for r in rows.select(text.extract_variant(F.col("t")).alias("v")).collect()] == ["flap", "cutting", None, None]


def _lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ", max_size=90), st.text("abcé ", max_size=90)), max_size=6))
def test_lcs(pairs):
    got = similarity.lcs_lengths([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [_lcs(a, b) for a, b in pairs]


# published confidences of seven lines: query, item, brand hit, share of numbers, confidence
PUBLISHED = [
    ("hitxeh ex bolt m10x75 zinc plated", "hitex hex bolt m10x75 zinc plated", 0.0, 1.0, 0.7606),
    ("vermont pvc paip 25mm class e", "vermont pvc pipe 25mm class e", 1.0, 1.0, 0.8776),
    ("vermont hose clip 13-19mm zinc x48", "vermont hose clip 13-19mm zinc", 1.0, 2 / 3, 0.8500),
    ("deliver by friday", "delivery fee", 0.0, 0.5, 0.4784),
    ("tolssen cable ie 300mm black", "tolsen cable tie 300mm black", 0.0, 1.0, 0.7768),
    ("vermont masking pita 48mm general", "vermont masking tape 48mm general", 1.0, 1.0, 0.8606),
    ("stallion pvc pipe class", "stallion pvc pipe 25mm class e", 1.0, 0.5, 0.8250),
]


@pytest.mark.parametrize("query, item, brand, numbers, confidence", PUBLISHED)
def test_published_confidences(query, item, brand, numbers, confidence):
    lex = similarity.SCORERS["token_set"]([query], [item])[0] / 100
    assert round(0.65 * lex + 0.10 * brand + 0.15 * numbers, 4) == pytest.approx(confidence, abs=1e-4)


def test_scorers_are_symmetric_and_bounded():
    words = ["bolt", "m8", "zinc", "plated bolt", "", "hex bolt m8 zinc plated long name", "brand"]
    for a, b in itertools.product(words, words):
        for name, score in similarity.SCORERS.items():
            x, y = score([a], [b])[0], score([b], [a])[0]
            assert x == pytest.approx(y), (name, a, b)
            assert 0 <= x <= 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["bolt", "hex", "m8", "zinc", "plated", "b", "valve", "ball"]), max_size=5).map(" ".join), min_size=1, max_size=200), st.sampled_from(["hex bolt", "valv ball", "", "zinc", "m8 x bolts hex"]))
def test_block_of_any_texts(texts, query):
    assert similarity.TokenBlock(texts).ratios(query).tolist() == similarity.SCORERS["token_set"]([query] * len(texts), texts).tolist()


def test_noise_tags(spark):
    rows = spark.createDataFrame([("pls send a/b  12mm bolts now", "S1", "", "1.0", ""), ("steel angle bar black", "", "", "", ""), ("hi", "", "9", "", "pcs")], "raw string, s string, b string, p string, u string")
    got = rows.select(text.noise_tags(*(F.col(x) for x in ("raw", "s", "b", "p", "u"))).alias("t")).collect()
    assert [r.t for r in got] == [["conversational_noise", "has_buyer_sku", "has_price", "measurement_text", "numeric_attributes", "separator_noise", "spacing_noise"], ["plain_text"], ["has_barcode", "has_uom", "short_text"]]


def test_generators_are_deterministic(spark):
    from quernstone.operators import generators

    items = generators.catalogue(spark, "acme", ["Bosco", "Hitex"], [(["Ball Valve", "Cable Tie"], ["25mm", "50mm", "75mm"])], 10)
    a, b = (sorted(map(tuple, generators.noisy_lines(items).collect())) for _ in range(2))
    assert a == b and len(a) == items.count() and all(x[-1] for x in a)
    assert items.where("disabled = '0'").count() >= 10
    ledger = generators.ledger(spark, 200, tenants=5, items=20, days=10)
    assert ledger["order_line"].count() == 200 and ledger["match_event"].count() > 600
    assert ledger["match_event"].join(ledger["order_line"], "line_id", "left_anti").count() == 0


@pytest.mark.parametrize("size", [1, 7, 40])
def test_bounds_leave_most_texts_out_and_no_best_one(size):
    """The best texts, each with its size, by bounds first: as of all ratios, with few recurrences."""
    import numpy as np

    words = ["m8", "m10", "hex", "bolt", "brass", "zinc", "nut", "50mm", "75mm", "große", "x" * 70, "ab", "ba"]
    rng = np.random.default_rng(size)
    texts = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(400)]
    block, sizes = similarity.TokenBlock(texts), rng.integers(1, size + 1, len(texts))
    asked, plain = [], block.ratios
    block.ratios = lambda query, some=None: (asked.append(len(texts) if some is None else len(some)), plain(query, some))[1]
    queries = [*texts[:60], "hex bolt unknown", "", "bolts heX", "ab ba ab", "qqq"]
    for query in queries:
        every, (low, high) = plain(query), block.bounds(query)
        assert (low <= every).all() and (every <= high).all()
        some, got = block.best(query, 30, sizes)
        assert got.tolist() == every[some].tolist()
        order = np.argsort(-every, kind="stable")
        least = every[order[np.searchsorted(np.cumsum(sizes[order]), 30)]]
        assert set(np.flatnonzero(every >= least)) <= set(some)
    assert sum(asked) < len(queries) * len(texts) / 2


def test_filled_is_what_stripping_leaves(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", " ", "　 ", " a", "\n", "\n\n", "a\n", "0", "\x1c", "​")], "t string")
    got = rows.select(text.filled(F.col("t")).alias("f"), (text.strip(F.coalesce("t", F.lit(""))) != "").alias("w")).collect()
    assert [r.f for r in got] == [r.w for r in got]


def test_the_best_of_several_queries_at_once():
    import numpy as np

    from quernstone.functions.similarity import SCORERS, TokenBlock

    texts = [f"brand {k % 7} {a} ring {k}mm" for k in range(40) for a in ("old", "new", "blue", "steel")] + ["", "a" * 70 + " brand", "é ü"]
    queries = ["brand 3 old ring 5mm", "", "zzz", "x" * 200, "steel ring 12mm x12 ctn", " ".join(f"w{k}" for k in range(90)), "é brand", "ring ring"]
    block, sizes = TokenBlock(texts), np.array([1 + k % 3 for k in range(len(texts))])
    for limit in (1, 5, 30):
        for query, (some, score) in zip(queries, block.best_of(queries, limit, sizes), strict=True):
            whole = SCORERS["token_set"]([query] * len(texts), texts)
            order = np.argsort(-whole, kind="stable")
            least = whole[order[np.searchsorted(np.cumsum(sizes[order]), limit)]]
            got = dict(zip(some.tolist(), score.tolist()))
            assert {k: round(x, 9) for k, x in got.items() if x >= least} == {k: round(x, 9) for k, x in enumerate(whole.tolist()) if x >= least}
