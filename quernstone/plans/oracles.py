"""The queries in DuckDB's SQL; nothing here is taken from the engine, so wrong constants of it show.

Each statement is a chain of common table expressions: the model views, then
what the query adds.  Texts in the model's views are ASCII, so the regular
expressions need no Unicode classes.
"""

from __future__ import annotations

# Fixed values, stated again for the SQL: windows, word lists, grids, bounds, bands and costs.
FIRST_DAY, LAST_DAY, CUTOFF = "2024-01-05", "2024-01-25", "2024-01-16 00:00:00"
LEADING = "item|product|order|qty"
FILLERS = "please|pls|need|urgent|send"
CHATTER = "pls|please|urgent|need|send|thanks|bro"
SYNONYMS = (("zp", "zinc plated"), ("ss304", "stainless 304"), ("ss316", "stainless 316"), ("putih", "white"))
VARIANTS = ("flap", "cutting", "grinding")
SWEEP_SCORES, SWEEP_MARGINS = (0.85, 0.90, 0.925, 0.95, 0.97, 0.98), (0.00, 0.01, 0.03, 0.05, 0.10)
SCORE_BOUNDS = (0.30, 0.40, 0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90)
BANDS = ((0.95, 0.10), (0.90, 0.10), (0.85, 0.10), (0.85, 0.05), (0.85, 0.03))
COST_CORRECT, COST_ABSTAIN, COST_WRONG = -20, 40, 800

ORACLES: dict[str, str] = {}


def _with(views: dict[str, str], last: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body.strip()})" for name, body in views.items()) + "\n" + last.strip()


# -- ledger

LEDGER = {
    "tenant": "SELECT r_regionkey AS tenant_id, r_name AS name, CASE r_regionkey % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' ELSE 'enterprise' END AS plan FROM region",
    "order_line": "SELECT event_id // 4 AS line_id, CAST((event_id // 4) % 5 AS INTEGER) AS tenant_id, user_id AS customer_id, event_type AS channel, ts AS created_at FROM events WHERE event_id % 4 = 0",
    "match_event": """
        SELECT e.event_id, l.tenant_id, l.line_id, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS item_code, (CAST(floor(e.value) AS BIGINT) % 64) / 64.0::DOUBLE AS score,
            e.event_id % 4 AS rank, e.event_type = 'purchase' AS accepted, CAST(floor(e.value) AS BIGINT) AS latency_ms, l.created_at
        FROM events e JOIN order_line l ON e.event_id // 4 = l.line_id""",
    "item": "SELECT tenant_id, CAST(c AS INTEGER) AS item_code, c % 16 = 0 AS disabled FROM tenant, range(100) AS r(c)",
}


def _report_views(first: str, last: str, tenant: str = "TRUE") -> dict[str, str]:
    span = f"CAST(created_at AS DATE) BETWEEN DATE '{first}' AND DATE '{last}' AND {tenant}"
    return LEDGER | {
        "om": f"""SELECT o.tenant_id, t.plan, o.channel, CAST(o.created_at AS DATE) AS day, count(DISTINCT line_id) AS lines_total, count(DISTINCT customer_id) AS distinct_customers
            FROM order_line o JOIN tenant t ON t.tenant_id = o.tenant_id WHERE {span.replace("tenant_id", "o.tenant_id")} GROUP BY ALL""",
        "cem": f"""SELECT o.tenant_id, o.channel, CAST(o.created_at AS DATE) AS day, count(DISTINCT CASE WHEN e.accepted THEN o.line_id END) AS lines_accepted, count(*) AS candidates_considered
            FROM order_line o JOIN match_event e ON e.line_id = o.line_id WHERE {span.replace("created_at", "o.created_at").replace("tenant_id", "o.tenant_id")} GROUP BY ALL""",
        "dem": f"""SELECT e.tenant_id, CAST(created_at AS DATE) AS day, avg(CASE WHEN accepted THEN score END) AS avg_accept_score, max(latency_ms) AS max_latency_ms, avg(latency_ms) AS avg_latency_ms,
                CAST(sum(CASE WHEN accepted AND i.disabled THEN 1 ELSE 0 END) AS BIGINT) AS accepted_disabled
            FROM match_event e LEFT JOIN item i ON i.tenant_id = e.tenant_id AND i.item_code = e.item_code WHERE {span.replace("tenant_id", "e.tenant_id")} GROUP BY ALL""",
        "numbered": f"""SELECT tenant_id, CAST(created_at AS DATE) AS day, latency_ms, row_number() OVER w AS rn, count(*) OVER (PARTITION BY tenant_id, CAST(created_at AS DATE)) AS cnt
            FROM match_event WHERE {span} WINDOW w AS (PARTITION BY tenant_id, CAST(created_at AS DATE) ORDER BY latency_ms)""",
        "pm": "SELECT tenant_id, day, max(CASE WHEN rn = (cnt * 95 + 99) // 100 THEN latency_ms END) AS p95_latency_ms FROM numbered GROUP BY ALL",
        "met": f"SELECT DISTINCT tenant_id, CAST(created_at AS DATE) AS day, item_code FROM match_event WHERE CAST(created_at AS DATE) BETWEEN DATE '{first}' - 1 AND DATE '{last}' AND {tenant}",
        "rm": f"SELECT a.tenant_id, a.day, count(*) AS repeat_items_prev_day FROM met a JOIN met b ON b.tenant_id = a.tenant_id AND b.item_code = a.item_code AND b.day = a.day - 1 WHERE a.day >= DATE '{first}' GROUP BY ALL",
    }


_METRICS = {
    "lines_total": "om.lines_total", "lines_accepted": "coalesce(cem.lines_accepted, 0) AS lines_accepted", "candidates_considered": "coalesce(cem.candidates_considered, 0) AS candidates_considered",
    "avg_accept_score": "dem.avg_accept_score", "max_latency_ms": "dem.max_latency_ms", "avg_latency_ms": "dem.avg_latency_ms", "distinct_customers": "om.distinct_customers",
    "repeat_items_prev_day": "coalesce(rm.repeat_items_prev_day, 0) AS repeat_items_prev_day", "accepted_disabled": "coalesce(dem.accepted_disabled, 0) AS accepted_disabled", "p95_latency_ms": "pm.p95_latency_ms",
}


def _report(first: str, last: str, without: tuple[str, ...] = (), tenant: str = "TRUE") -> str:
    metrics = ", ".join(v for k, v in _METRICS.items() if k not in without)
    return _with(
        _report_views(first, last, tenant),
        f"""SELECT om.tenant_id, om.plan, om.channel, om.day, {metrics} FROM om
        LEFT JOIN cem ON cem.tenant_id = om.tenant_id AND cem.channel = om.channel AND cem.day = om.day
        LEFT JOIN dem ON dem.tenant_id = om.tenant_id AND dem.day = om.day
        LEFT JOIN rm ON rm.tenant_id = om.tenant_id AND rm.day = om.day
        LEFT JOIN pm ON pm.tenant_id = om.tenant_id AND pm.day = om.day ORDER BY 1, 3, 4""",
    )


_VIEWS = _report_views(FIRST_DAY, LAST_DAY)
ORACLES |= {
    "report_tenant_health": _report(FIRST_DAY, LAST_DAY),
    "report_correlated": _report(FIRST_DAY, LAST_DAY, ("p95_latency_ms",)),
    "report_one_day": _report(FIRST_DAY, FIRST_DAY),
    "report_one_tenant_one_day": _report(FIRST_DAY, FIRST_DAY, (), "tenant_id = 0"),
    "report_no_repeat": _report(FIRST_DAY, LAST_DAY, ("repeat_items_prev_day",)),
    "report_no_accepted": _report(FIRST_DAY, LAST_DAY, ("lines_accepted",)),
    "report_no_disabled": _report(FIRST_DAY, LAST_DAY, ("accepted_disabled",)),
    "report_no_candidates": _report(FIRST_DAY, LAST_DAY, ("candidates_considered",)),
    "order_metrics": _with(_VIEWS, "SELECT * FROM om"),
    "channel_event_metrics": _with(_VIEWS, "SELECT * FROM cem"),
    "day_event_metrics": _with(_VIEWS, "SELECT * FROM dem"),
    "p95_window": _with(_VIEWS, "SELECT * FROM pm"),
    "p95_percentile_disc": _with(_VIEWS, "SELECT * FROM pm"),
    "p95_cross_check": _with(_VIEWS, "SELECT tenant_id, day, p95_latency_ms AS p95_window, p95_latency_ms AS p95_aggregate, TRUE AS equal FROM pm"),
    "event_items": _with(_VIEWS, "SELECT * FROM met"),
    "repeat_items_prev_day": _with(_VIEWS, "SELECT * FROM rm"),
    "busiest_tenant_day": _with(_VIEWS, "SELECT n.tenant_id, n.day, max(n.cnt) AS n, max(pm.p95_latency_ms) AS p95_latency_ms FROM numbered n JOIN pm ON pm.tenant_id = n.tenant_id AND pm.day = n.day GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1"),
    "matcher_latency_percentiles": _with(
        LEDGER,
        "SELECT count(*) AS n, avg(latency_ms) AS avg_ms, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, quantile_disc(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms FROM match_event",
    ),
    "slice_counts": _with(
        LEDGER,
        f"""SELECT 'tenant' AS relation, count(*) AS n_rows FROM tenant UNION ALL SELECT 'item', count(*) FROM item
        UNION ALL SELECT 'order_line', count(*) FROM order_line WHERE CAST(created_at AS DATE) BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'
        UNION ALL SELECT 'match_event', count(*) FROM match_event WHERE CAST(created_at AS DATE) BETWEEN DATE '{FIRST_DAY}' - 1 AND DATE '{LAST_DAY}'""",
    ),
}

#: Days leave as text.
for _name in ("report_tenant_health", "report_correlated", "report_one_day", "report_one_tenant_one_day", "report_no_repeat", "report_no_accepted", "report_no_disabled", "report_no_candidates",
              "order_metrics", "channel_event_metrics", "day_event_metrics", "p95_window", "p95_percentile_disc", "p95_cross_check", "event_items", "repeat_items_prev_day", "busiest_tenant_day"):
    ORACLES[_name] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({ORACLES[_name]})"

# -- matcher's views

_PART = "'P' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')"
_TENANT = "CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END"
_NAME = "p_brand || ' ' || p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) || 'mm'"
_SKU = "'S' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')"
_BARCODE = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '9' || lpad(CAST(p_partkey // 4 AS VARCHAR), 11, '0') END"


def _line(wide: bool = False) -> str:
    k = "x.l_orderkey"
    return f"""
        SELECT x.l_orderkey AS line_id, {_TENANT} AS tenant, 'CUST-' || CAST(p_partkey % 8 AS VARCHAR) AS customer_id, strftime(o.o_orderdate, '%Y-%m-%d') AS order_date,
            CASE {k} % 8 WHEN 0 THEN {_NAME} WHEN 1 THEN upper({_NAME}) WHEN 2 THEN p_name || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) || 'mm' WHEN 3 THEN 'pls send ' || {_NAME}
                WHEN 4 THEN 'item: ' || {_NAME} WHEN 5 THEN {_NAME} || ' x12 ctn' WHEN 6 THEN replace({_NAME}, ' ', '/') ELSE p_brand END AS raw_text,
            p_retailprice * CASE {k} % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.05::DOUBLE WHEN 2 THEN 1.2::DOUBLE WHEN 3 THEN 1.4::DOUBLE ELSE 2.0::DOUBLE END AS unit_price,
            {_SKU if wide else f"CASE WHEN {k} % 5 = 1 THEN {_SKU} ELSE '' END"} AS buyer_sku,
            {_BARCODE if wide else f"CASE WHEN {k} % 5 = 0 THEN {_BARCODE} ELSE '' END"} AS raw_barcode,
            CASE {k} % 3 WHEN 0 THEN 'pcs' WHEN 1 THEN 'ctn' ELSE '' END AS uom_text,
            CASE WHEN {k} % 8 = 7 THEN '' ELSE {_PART} END AS gt_item_code
        FROM (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1) x JOIN part ON p_partkey = x.pk JOIN orders o ON o.o_orderkey = x.l_orderkey"""


CATALOGUE = {
    "base_items": f"SELECT {_TENANT} AS tenant, {_PART} AS item_code, {_NAME} AS item_name, p_brand AS brand, CASE WHEN p_partkey % 20 = 0 THEN '1' ELSE '0' END AS disabled, p_retailprice AS list_price, {_BARCODE} AS barcode, p_partkey AS row_ord, 'type ' || p_type AS description, p_partkey % 7 AS available_qty FROM part",
    "catalogue": "SELECT * FROM base_items UNION ALL SELECT * REPLACE (item_code || '-OLD' AS item_code, '1' AS disabled) FROM base_items WHERE row_ord % 25 = 0",
    "active": "SELECT * FROM catalogue WHERE disabled = '0'",
}
ALIAS = {
    "alias": f"""
        SELECT {_TENANT} AS tenant, 'CUST-' || CAST(p_partkey % 8 AS VARCHAR) AS customer_id, {_SKU} AS customer_sku, u.item_code, '1995-01-01' AS valid_from, u.valid_to, CASE WHEN p_partkey % 3 = 1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence
        FROM part, LATERAL (
            SELECT {_PART} AS item_code, '' AS valid_to WHERE p_partkey % 5 = 1
            UNION ALL SELECT {_PART} || '-OLD', '' WHERE p_partkey % 25 = 0
            UNION ALL SELECT 'P' || lpad(CAST(p_partkey + 2 AS VARCHAR), 6, '0'), '1996-12-31' WHERE p_partkey % 15 = 1) u"""
}
LANES = {
    "barcode_lane": "SELECT l.line_id, min(a.item_code) AS item_code FROM line l JOIN active a ON a.tenant = l.tenant AND a.barcode = l.raw_barcode WHERE l.raw_barcode <> '' GROUP BY 1 HAVING count(*) = 1",
    "mapped": "SELECT l.line_id, l.tenant, a.item_code AS target FROM line l JOIN alias a ON a.tenant = l.tenant AND a.customer_id = l.customer_id AND a.customer_sku = l.buyer_sku AND l.order_date >= a.valid_from AND (a.valid_to = '' OR l.order_date <= a.valid_to)",
    "led": """SELECT m.line_id, coalesce((SELECT max(a.item_code) FROM active a WHERE a.tenant = m.tenant AND a.item_code = m.target),
            (SELECT max(a.item_code) FROM active a WHERE a.tenant = m.tenant AND m.target LIKE '%-OLD' AND a.item_code = regexp_replace(m.target, '-OLD$', ''))) AS item_code FROM mapped m""",
    "alias_lane": "SELECT line_id, min(item_code) AS item_code FROM led WHERE item_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT item_code) = 1",
    "strong": """SELECT coalesce(b.line_id, a.line_id) AS line_id,
            CASE WHEN a.item_code = b.item_code THEN 'barcode+alias' WHEN a.item_code IS NOT NULL AND b.item_code IS NOT NULL THEN 'identifier_conflict' WHEN b.item_code IS NOT NULL THEN 'barcode' ELSE 'alias' END AS source,
            CASE WHEN a.item_code <> b.item_code THEN 'review' ELSE 'auto' END AS decision,
            CASE WHEN a.item_code <> b.item_code THEN NULL ELSE coalesce(b.item_code, a.item_code) END AS item_code,
            CASE WHEN a.item_code <> b.item_code THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence
        FROM barcode_lane b FULL JOIN alias_lane a ON a.line_id = b.line_id""",
}
_WIDE = {"line": _line(wide=True)} | CATALOGUE | ALIAS | LANES

# -- text


def norm(c: str) -> str:
    """The normalisation's steps as nested replacements."""
    q = "(?:''''|\"|”)"
    steps = [
        (rf"(\d+)\s*/\s*(\d+)\s*{q}", r"\1<FRAC>\2in"), (rf"{q}\s*(\d+(?:\.\d+)?)\s*([a-z])", r"\1in \2"), (rf"(\d+(?:\.\d+)?)\s*{q}", r"\1in"), ("[/_|,;:]+", " "), ("<FRAC>", "/"),
        (rf"^\s*({LEADING})\s*[-:=]?\s*", ""), (rf"\b(?:{FILLERS})\b", " "), *((rf"\b{a}\b", b) for a, b in SYNONYMS), (r"\s+-\s+", " "), (r"\s+", " "),
    ]
    out = f"lower(coalesce({c}, ''))"
    for pattern, new in steps:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim({out})"


def numbers_views(source: str, key: str, c: str) -> dict[str, str]:
    """Views that give ``numbers_<key>`` (key, list) of a normalised text, which is normalised once more."""
    return {
        f"n1_{key}": f"SELECT {key}, {norm(c)} AS t FROM {source}",
        f"n2_{key}": rf"SELECT {key}, t, regexp_replace(t, '\b\d+/\d+in\b', ' ', 'g') AS t2 FROM n1_{key}",
        f"numbers_{key}": rf"""SELECT {key}, list_sort(list_distinct(list_concat(regexp_extract_all(t, '\b\d+/\d+in\b'), regexp_extract_all(t2, '\b\d+(?:\.\d+)?in\b'),
            regexp_extract_all(regexp_replace(t2, '\b\d+(?:\.\d+)?in\b', ' ', 'g'), '\d+(?:\.\d+)?')))) AS numbers FROM n2_{key}""",
    }


def variant(c: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains(string_split({norm(c)}, ' '), '{x}') THEN '{x}'" for x in VARIANTS) + " END"


_TAG_TESTS = {
    "short_text": r"len(regexp_extract_all(raw_text, '\w+')) <= 3", "conversational_noise": rf"regexp_matches(lower(raw_text), '\b(?:{CHATTER})\b')", "separator_noise": "regexp_matches(raw_text, '[/_|]')",
    "spacing_noise": r"regexp_matches(raw_text, '\s{2,}')", "numeric_attributes": r"regexp_matches(raw_text, '\d')",
    "measurement_text": r"""regexp_matches(raw_text, '\d+\s*["'']') OR regexp_matches(lower(raw_text), '\d+\s*(?:mm|kg|g|l)\b')""",
    "has_buyer_sku": "buyer_sku <> ''", "has_barcode": "raw_barcode <> ''", "has_price": "unit_price IS NOT NULL", "has_uom": "uom_text <> ''",
}
_TAGS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _TAG_TESTS.items()) + "], lambda x: x IS NOT NULL))"
TAGGED = {"tagged": f"SELECT line_id, CASE WHEN len({_TAGS}) = 0 THEN ['plain_text'] ELSE {_TAGS} END AS tags FROM line"}
_LINE = {"line": _line()}

ORACLES |= {
    "normalize_text": _with(_LINE, f"SELECT line_id, {norm('raw_text')} AS normalized FROM line"),
    # full-width characters are the visible ones of ASCII, an accent joins its letter, a number in a ring is the number
    "normalize_wide": _with(_LINE, f"SELECT line_id, {norm("raw_text || ' caf\u00e9 1'")} AS normalized FROM line"),
    "extract_numbers": _with(_LINE | {"q": f"SELECT line_id, {norm('raw_text')} AS t FROM line"} | numbers_views("q", "line_id", "t"), "SELECT line_id, array_to_string(numbers, ',') AS numbers FROM numbers_line_id"),
    "extract_variant": "WITH x AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' flap disc' WHEN 1 THEN ' Grinding Disc' WHEN 2 THEN ' cutting wheel' WHEN 3 THEN ' flap cutting' ELSE '' END AS t FROM part) SELECT p_partkey, " + variant("t") + " AS variant FROM x",
    "noise_tags": _with(_LINE | TAGGED, "SELECT line_id, array_to_string(tags, ',') AS tags FROM tagged"),
    "slug_codes": "SELECT p_partkey, regexp_replace(upper(p_brand || '-' || p_name), '[^A-Z0-9]', '', 'g') AS slug FROM part",
    "barcode_lane": _with(_WIDE, "SELECT * FROM barcode_lane"),
    "alias_lane": _with(_WIDE, "SELECT * FROM alias_lane"),
    "identifier_arbitration": _with(_WIDE, "SELECT * FROM strong"),
    "alias_superseded": _with(
        CATALOGUE | ALIAS,
        """SELECT s.tenant, count(*) AS n_stale, count(h.item_code) AS n_successor, count(*) - count(h.item_code) AS n_none
        FROM (SELECT * FROM alias a WHERE EXISTS (SELECT 1 FROM catalogue c WHERE c.tenant = a.tenant AND c.item_code = a.item_code AND c.disabled = '1')) s
        LEFT JOIN active h ON h.tenant = s.tenant AND s.item_code LIKE '%-OLD' AND h.item_code = regexp_replace(s.item_code, '-OLD$', '') GROUP BY 1""",
    ),
    "barcode_ambiguity": _with(CATALOGUE, "SELECT tenant, barcode, count(*) AS n_items FROM active WHERE barcode <> '' GROUP BY 1, 2"),
    "alias_conflicts": _with(ALIAS, "SELECT tenant, customer_id, customer_sku, CAST(count(DISTINCT item_code) AS INTEGER) AS n_items, array_to_string(list_sort(list_distinct(list(item_code))), ',') AS codes FROM alias GROUP BY 1, 2, 3 HAVING count(DISTINCT item_code) > 1"),
    "alias_cross_tenant_lookalike": _with(
        CATALOGUE | ALIAS | {"swapped": "SELECT * REPLACE (CASE tenant WHEN 'alpha' THEN 'beta' ELSE 'alpha' END AS tenant) FROM alias"},
        """SELECT s.tenant, count(*) AS n_mappings FROM swapped s WHERE EXISTS (SELECT 1 FROM catalogue c WHERE c.item_code = s.item_code AND c.tenant <> s.tenant)
        AND NOT EXISTS (SELECT 1 FROM catalogue c WHERE c.item_code = s.item_code AND c.tenant = s.tenant) GROUP BY 1""",
    ),
}

ORACLES |= {
    "alias_misses": _with(
        _WIDE,
        """SELECT l.tenant, count(*) AS n_unresolved, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM alias a WHERE a.tenant = l.tenant AND a.customer_id = l.customer_id AND a.customer_sku = l.buyer_sku)) AS n_own,
        count(*) FILTER (WHERE EXISTS (SELECT 1 FROM alias a WHERE a.customer_sku = l.buyer_sku)) AS n_any FROM line l WHERE l.buyer_sku <> '' AND NOT EXISTS (SELECT 1 FROM alias_lane x WHERE x.line_id = l.line_id) GROUP BY 1""",
    ),
    "superseded_quality": _with(
        _WIDE | {
            "met": """SELECT l.tenant, l.gt_item_code, h.item_code FROM line l JOIN alias a ON a.tenant = l.tenant AND a.customer_id = l.customer_id AND a.customer_sku = l.buyer_sku
                JOIN (SELECT DISTINCT tenant, item_code FROM catalogue WHERE disabled = '1') o ON o.tenant = a.tenant AND o.item_code = a.item_code
                LEFT JOIN active h ON h.tenant = a.tenant AND a.item_code LIKE '%-OLD' AND h.item_code = regexp_replace(a.item_code, '-OLD$', '')"""
        },
        """SELECT tenant, count(*) AS n_met, count(item_code) AS n_successor, count(*) FILTER (WHERE item_code = gt_item_code) AS n_right, count(*) FILTER (WHERE item_code <> gt_item_code) AS n_wrong, count(*) - count(item_code) AS n_none FROM met GROUP BY 1""",
    ),
}

# -- similarity: insertions and deletions by a bit-parallel recurrence over the second string's letters


def _lcs(a: str, b: str) -> str:
    full = f"((1::HUGEINT << len({a})) - 1)"
    mask = f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN substr({a}, CAST(i AS INTEGER), 1) = c THEN (1::HUGEINT << CAST(i - 1 AS INTEGER)) ELSE 0::HUGEINT END))"
    steps = f"list_transform(string_split({b}, ''), lambda c: CAST(coalesce({mask}, 0) AS HUGEINT))"
    step = f"list_reduce({steps}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len({a}) - bit_count({step}) END)"


def set_ratio_views(pairs: str) -> dict[str, str]:
    """``ratios`` (all columns of ``pairs``, ratio) for pairs with word lists qw and tw.

    The rests of either side repeat over the pairs, so the letters' places are found once for each rest.
    """
    place = "list_sum(list_transform(range(1, len(sa) + 1), lambda i: CASE WHEN ascii(substr(sa, CAST(i AS INTEGER), 1)) = c THEN (1::HUGEINT << CAST(i - 1 AS INTEGER)) ELSE 0::HUGEINT END))"
    return {
        "split": f"""SELECT *, array_to_string(list_filter(qw, lambda x: list_contains(tw, x)), ' ') AS si, array_to_string(list_filter(qw, lambda x: NOT list_contains(tw, x)), ' ') AS sa,
            array_to_string(list_filter(tw, lambda x: NOT list_contains(qw, x)), ' ') AS sb FROM {pairs}""",
        "firsts": f"SELECT sa, (1::HUGEINT << len(sa)) - 1 AS ones, list_transform(range(0, 128), lambda c: CAST(coalesce({place}, 0) AS HUGEINT)) AS masks FROM (SELECT DISTINCT sa FROM split)",
        "seconds": "SELECT sb, list_transform(string_split(sb, ''), lambda c: ascii(c) + 1) AS letters FROM (SELECT DISTINCT sb FROM split)",
        "measured": """SELECT s.*, CAST(len(si) AS DOUBLE) AS ls, CAST(len(s.sa) AS DOUBLE) AS la, CAST(len(s.sb) AS DOUBLE) AS lb, CASE WHEN len(si) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sp,
            CASE WHEN len(s.sa) = 0 OR len(s.sb) = 0 THEN 0 ELSE len(s.sa) - bit_count(list_reduce(list_transform(letters, lambda c: masks[c]), lambda s, m: ((s + (s & m)) | (s - (s & m))) & ones, ones)) END AS lcs
            FROM split s JOIN firsts USING (sa) JOIN seconds USING (sb)""",
        "ratios": """SELECT *, CASE WHEN len(qw) = 0 OR len(tw) = 0 THEN 0.0::DOUBLE WHEN ls > 0 AND (la = 0 OR lb = 0) THEN 100.0::DOUBLE
            WHEN ls = 0 THEN 100.0::DOUBLE - 100.0::DOUBLE * (la + lb - 2 * lcs) / (ls + sp + la + ls + sp + lb)
            ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (la + lb - 2 * lcs) / (ls + sp + la + ls + sp + lb), 100.0::DOUBLE - 100.0::DOUBLE * (sp + la) / (ls + ls + sp + la), 100.0::DOUBLE - 100.0::DOUBLE * (sp + lb) / (ls + ls + sp + lb)) END AS ratio FROM measured""",
    }


def words(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> '')))"


_OWN = {"line": _line()} | CATALOGUE | {
    "named": f"SELECT l.line_id, {norm('l.raw_text')} AS q, {norm('c.item_name')} AS t FROM line l JOIN catalogue c ON c.item_code = l.gt_item_code",
    "pairs": f"SELECT line_id, q, t, {words('q')} AS qw, {words('t')} AS tw FROM named",
}
ORACLES["token_set_ratio"] = _with(_OWN | set_ratio_views("pairs"), "SELECT line_id, round(ratio, 6) AS ratio FROM ratios")
ORACLES["token_sort_ratio"] = _with(
    _OWN | {"sorted": "SELECT line_id, array_to_string(list_sort(list_filter(string_split(q, ' '), lambda x: x <> '')), ' ') AS a, array_to_string(list_sort(list_filter(string_split(t, ' '), lambda x: x <> '')), ' ') AS b FROM named"},
    f"SELECT line_id, round(100.0::DOUBLE - 100.0::DOUBLE * (len(a) + len(b) - 2.0::DOUBLE * {_lcs('a', 'b')}) / (len(a) + len(b)), 6) AS ratio FROM sorted",
)

# -- matching

_ITEM_NUMBERS = numbers_views("items0", "item_code", "search_text")
_QUERY_NUMBERS = numbers_views("lines0", "line_id", "query_text")
_PRICE = "abs(unit_price - list_price) / list_price"
RANKED = (
    {"line": _line()}
    | CATALOGUE
    | ALIAS
    | LANES
    | {
        "items0": f"SELECT *, {norm('item_name')} AS name_text, {norm("item_name || ' ' || description || ' ' || brand")} AS search_text, {norm('brand')} AS brand_text FROM active",
        "lines0": f"SELECT *, {norm('raw_text')} AS query_text FROM line",
    }
    | _ITEM_NUMBERS
    | _QUERY_NUMBERS
    | {
        "items1": f"SELECT i.*, n.numbers AS item_numbers, {variant('search_text')} AS item_variant, {words('name_text')} AS tw FROM items0 i JOIN numbers_item_code n ON n.item_code = i.item_code",
        "lines1": f"SELECT l.*, n.numbers AS query_numbers, {variant('query_text')} AS query_variant, {words('query_text')} AS qw FROM lines0 l JOIN numbers_line_id n ON n.line_id = l.line_id",
        "asked": "SELECT DISTINCT tenant, qw FROM lines1",
        "pairs": "SELECT a.tenant, i.item_code, i.row_ord, a.qw, i.tw FROM asked a JOIN items1 i ON i.tenant = a.tenant",
    }
    | set_ratio_views("pairs")
    | {
        "best": "SELECT tenant, qw, item_code, ratio / 100.0::DOUBLE AS lex, row_number() OVER (PARTITION BY tenant, qw ORDER BY ratio / 100.0::DOUBLE DESC, row_ord, item_code) AS lex_rank FROM ratios QUALIFY lex_rank <= 30",
        "retrieved": "SELECT l.line_id, b.item_code, b.lex, b.lex_rank FROM best b JOIN lines1 l ON l.tenant = b.tenant AND l.qw = b.qw",
        "scored": f"""SELECT r.*, l.gt_item_code, l.unit_price, CASE WHEN i.brand_text <> '' AND contains(l.query_text, i.brand_text) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS brand_match,
            CASE WHEN len(l.query_numbers) = 0 THEN 0.5::DOUBLE ELSE CAST(len(list_intersect(l.query_numbers, i.item_numbers)) AS DOUBLE) / len(l.query_numbers) END AS numeric_score,
            CASE WHEN l.query_variant IS NULL THEN 0.5::DOUBLE WHEN l.query_variant IS NOT DISTINCT FROM i.item_variant THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS variant_score,
            CASE WHEN l.unit_price IS NULL OR i.list_price IS NULL OR l.unit_price <= 0 OR i.list_price <= 0 THEN 0.5::DOUBLE WHEN {_PRICE} <= 0.10::DOUBLE THEN 1.0::DOUBLE WHEN {_PRICE} <= 0.25::DOUBLE THEN 0.8::DOUBLE WHEN {_PRICE} <= 0.50::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS price_score
            FROM retrieved r JOIN lines1 l ON l.line_id = r.line_id JOIN items1 i ON i.item_code = r.item_code AND i.tenant = l.tenant""",
        "totals": """SELECT *, 0.55::DOUBLE * lex + 0.10::DOUBLE * brand_match + 0.15::DOUBLE * numeric_score + 0.10::DOUBLE * variant_score + 0.10::DOUBLE * price_score AS rank_score,
            0.65::DOUBLE * lex + 0.10::DOUBLE * brand_match + 0.15::DOUBLE * numeric_score AS confidence_score FROM scored""",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY rank_score DESC, lex_rank) AS rank FROM totals QUALIFY rank <= 20",
        "lexical": """SELECT line_id, max(CASE WHEN rank = 1 THEN item_code END) AS item_code, max(CASE WHEN rank = 1 THEN confidence_score END) AS confidence,
            max(CASE WHEN rank = 1 THEN confidence_score END) - coalesce(max(CASE WHEN rank > 1 THEN confidence_score END), 0.0::DOUBLE) AS margin, count(*) AS n_candidates,
            list(item_code ORDER BY rank) AS codes, list(confidence_score ORDER BY rank) AS scores FROM ranked GROUP BY 1""",
        "decided": """SELECT l.line_id, l.tenant, l.gt_item_code, coalesce(s.source, 'lexical') AS source,
            CASE WHEN s.line_id IS NOT NULL THEN s.decision WHEN x.line_id IS NULL THEN 'no_match' WHEN x.confidence >= 0.85::DOUBLE AND x.margin >= 0.10::DOUBLE THEN 'auto' WHEN x.confidence < 0.70::DOUBLE THEN 'no_match' ELSE 'review' END AS decision,
            CASE WHEN s.line_id IS NOT NULL THEN s.item_code ELSE x.item_code END AS item_code, CASE WHEN s.line_id IS NOT NULL THEN s.confidence ELSE coalesce(x.confidence, 0) END AS confidence,
            CASE WHEN s.line_id IS NULL THEN x.margin END AS margin, CASE WHEN s.line_id IS NULL THEN x.codes ELSE [] END AS codes, CASE WHEN s.line_id IS NULL THEN x.scores ELSE [] END AS scores
            FROM line l LEFT JOIN strong s ON s.line_id = l.line_id LEFT JOIN lexical x ON x.line_id = l.line_id""",
    }
)
_POS, _OK = "gt_item_code <> ''", "(gt_item_code <> '' AND item_code IS NOT DISTINCT FROM gt_item_code)"


def _n(test: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {test}) AS {name}"


def _share(a: str, b: str, name: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE round(CAST({a} AS DOUBLE) / {b}, 6) END AS {name}"


_COUNTS = ", ".join(
    ["count(*) AS rows", _n(_POS, "positive_gt"), _n(f"NOT ({_POS})", "blank_gt"), _n("decision = 'auto'", "auto"), _n(f"decision = 'auto' AND {_OK}", "auto_correct"), _n(f"decision = 'auto' AND NOT {_OK}", "auto_wrong"), _n("decision = 'review'", "review"), _n("decision = 'no_match'", "no_match")]
)


def _grouped(source: str, key: str) -> str:
    return f"SELECT *, {_share('auto_correct', 'auto', 'precision')}, {_share('auto', 'rows', 'coverage')} FROM (SELECT {key}, {_COUNTS} FROM {source} GROUP BY 1)"


_STRONG = "source IN ('barcode', 'alias', 'barcode+alias')"
_REASON = """CASE source WHEN 'barcode+alias' THEN 'identifier_agree' WHEN 'barcode' THEN 'barcode_hit' WHEN 'alias' THEN 'alias_exact' WHEN 'identifier_conflict' THEN 'identifier_conflict'
    ELSE CASE decision WHEN 'auto' THEN 'lexical_unique' WHEN 'review' THEN 'lexical_ambiguous' ELSE 'no_candidate_above_floor' END END"""
_TOP3 = "array_to_string(list_transform(range(1, least(len(codes), 3) + 1), lambda i: codes[i] || ':' || printf('%.4f', round(scores[i], 4))), '|')"
_PREDICTED = f"""SELECT CAST(line_id AS VARCHAR) AS line_id, CASE WHEN decision = 'auto' THEN coalesce(item_code, '') ELSE '' END AS item_code, printf('%.4f', round(confidence, 4)) AS confidence,
    CASE decision WHEN 'no_match' THEN 'reject' ELSE decision END AS decision, {_REASON} AS reason_code, CASE WHEN decision = 'auto' AND source <> 'lexical' THEN item_code || ':1.0000' ELSE {_TOP3} END AS candidates FROM decided"""
_HOLDOUT = f"""SELECT count(*) AS n_lines, {_n("decision = 'auto'", 'n_auto')}, {_n(f"decision = 'auto' AND {_OK}", 'n_correct')}, {_n(f"decision = 'auto' AND NOT {_OK}", 'n_wrong')}, {_n("decision <> 'auto'", 'n_abstained')},
    {_n(f'NOT ({_POS})', 'abstain_should')}, {_n(f"NOT ({_POS}) AND decision <> 'auto'", 'abstain_right')}, {_n(f"decision <> 'auto' AND {_POS}", 'recall3_total')},
    {_n(f"decision <> 'auto' AND {_POS} AND list_contains(list_slice(codes, 1, 3), gt_item_code)", 'recall3_hits')},
    CAST(sum(CASE WHEN decision = 'auto' AND {_OK} THEN {COST_CORRECT} WHEN decision = 'auto' THEN {COST_WRONG} ELSE {COST_ABSTAIN} END) AS BIGINT) AS cost, {COST_ABSTAIN} * count(*) AS cost_abstain_all,
    CAST(sum(CASE WHEN {_POS} THEN {COST_CORRECT} ELSE {COST_ABSTAIN} END) AS BIGINT) AS cost_oracle FROM decided"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in r) + ")" for r in rows)


ORACLES |= {
    "lexical_topk": _with(RANKED, "SELECT line_id, item_code, round(lex, 6) AS lexical_score, CAST(lex_rank AS INTEGER) AS lex_rank FROM retrieved"),
    "rerank_topk": _with(RANKED, "SELECT line_id, item_code, CAST(rank AS INTEGER) AS rank, round(rank_score, 6) AS rank_score, round(confidence_score, 6) AS confidence_score FROM ranked"),
    "score_components": _with(RANKED, "SELECT line_id, item_code, brand_match, round(numeric_score, 6) AS numeric_score, variant_score, price_score FROM ranked"),
    "decide": _with(RANKED, "SELECT line_id, source, decision, item_code, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM decided"),
    "predictions": _with(RANKED, _PREDICTED),
    "eval_summary": _with(
        RANKED | {
            "main": f"""SELECT {_COUNTS}, {_n(f"decision = 'review' AND {_POS}", 'review_positive')}, {_n(f"decision = 'review' AND NOT ({_POS})", 'review_blank')}, {_n(f"decision = 'no_match' AND NOT ({_POS})", 'no_match_correct')},
                {_n(f"decision = 'no_match' AND {_POS}", 'no_match_wrong')}, {_n(_STRONG, 'strong_total')}, {_n(f'{_STRONG} AND {_OK}', 'strong_correct')} FROM decided""",
            "hits": f"SELECT {_n('rank = 1', 'top1_correct')}, {_n('rank <= 5', 'top5_correct')} FROM ranked WHERE {_POS} AND item_code = gt_item_code",
        },
        f"""SELECT *, {_share('auto_correct', 'auto', 'auto_precision')}, {_share('auto', 'rows', 'auto_coverage')}, {_share('no_match_correct', 'no_match', 'no_match_precision')}, {_share('no_match_correct', 'blank_gt', 'no_match_blank_recall')},
        {_share('top1_correct', 'positive_gt', 'top1_accuracy')}, {_share('top5_correct', 'positive_gt', 'top5_recall')}, {_share('strong_correct', 'strong_total', 'strong_precision')}, 20 * auto_wrong + review + no_match AS relative_cost FROM main, hits""",
    ),
    "eval_by_tenant": _with(RANKED, _grouped("decided", "tenant")),
    "eval_by_noise": _with(RANKED | TAGGED | {"flat": "SELECT line_id, unnest(tags) AS tag FROM tagged", "by_tag": "SELECT d.*, t.tag FROM decided d JOIN flat t ON t.line_id = d.line_id"}, _grouped("by_tag", "tag")),
    "threshold_sweep": _with(
        RANKED | {
            "grid": f"SELECT * FROM (VALUES {_values([(s, m) for s in SWEEP_SCORES for m in SWEEP_MARGINS])}) AS g(score_threshold, margin_threshold)",
            "paired": f"SELECT d.gt_item_code, CASE WHEN {_STRONG.replace('source', 'd.source')} THEN d.item_code END AS strong, x.item_code AS fuzzy, x.confidence, CASE WHEN x.n_candidates > 1 THEN x.margin ELSE 0.0::DOUBLE END AS gap FROM decided d LEFT JOIN lexical x ON x.line_id = d.line_id",
            "each": "SELECT g.*, b.*, b.strong IS NULL AND b.confidence >= g.score_threshold AND b.gap >= g.margin_threshold AS by_score FROM paired b, grid g",
            "picked": "SELECT *, coalesce(strong, CASE WHEN by_score THEN fuzzy END) AS chosen FROM each",
            "cells": f"SELECT score_threshold, margin_threshold, count(*) AS n, {_n('chosen IS NOT NULL', 'auto')}, {_n(f'chosen IS NOT NULL AND {_POS} AND chosen = gt_item_code', 'correct')}, {_n('strong IS NOT NULL', 'strong')}, {_n('by_score', 'lexical')} FROM picked GROUP BY 1, 2",
        },
        f"SELECT score_threshold, margin_threshold, auto, correct, auto - correct AS wrong, strong, lexical, {_share('correct', 'auto', 'precision')}, round(CAST(auto AS DOUBLE) / n, 6) AS coverage FROM cells",
    ),
    "score_distribution": _with(
        RANKED | {"grid": f"SELECT * FROM (VALUES {_values([(x,) for x in SCORE_BOUNDS])}) AS g(threshold)"},
        f"SELECT threshold, {_n(f'confidence >= threshold AND {_POS}', 'positive_reached')}, {_n(f'confidence >= threshold AND NOT ({_POS})', 'blank_reached')}, {_n(f'confidence < threshold AND {_POS}', 'positive_below')}, {_n(f'confidence < threshold AND NOT ({_POS})', 'blank_below')} FROM lexical JOIN line USING (line_id), grid GROUP BY 1",
    ),
    "blank_gt_bands": _with(
        RANKED | {"grid": f"SELECT * FROM (VALUES {_values(BANDS)}) AS g(low_score, low_margin)"},
        f"SELECT low_score, low_margin, {_n('margin >= low_margin AND confidence >= low_score', 'n_band')}, {_n('margin >= low_margin', 'n_margin')} FROM lexical JOIN line USING (line_id), grid WHERE NOT ({_POS}) GROUP BY 1, 2",
    ),
    "gt_rank_buckets": _with(
        RANKED | {"place": "SELECT line_id, min(rank) AS r FROM ranked WHERE item_code = gt_item_code GROUP BY 1"},
        f"SELECT count(*) AS n_lines, {_n('r = 1', '\"first\"')}, {_n('r = 2', '\"second\"')}, {_n('r <= 3', 'within_3')}, {_n('r <= 5', 'within_5')}, {_n('r <= 20', 'within_20')}, {_n('r IS NULL', 'missing')} FROM line LEFT JOIN place USING (line_id) WHERE {_POS}",
    ),
    "cost_model": _with(RANKED, f"SELECT n_lines, cost, cost_abstain_all, cost_oracle FROM ({_HOLDOUT})"),
    "recall_at_3": _with(
        RANKED,
        f"SELECT * EXCLUDE (cost, cost_abstain_all, cost_oracle), {_share('n_correct', 'n_auto', 'precision')}, {_share('n_auto', 'n_lines', 'coverage')}, {_share('abstain_right', 'abstain_should', 'abstain_share')}, {_share('recall3_hits', 'recall3_total', 'recall3')} FROM ({_HOLDOUT})",
    ),
    "class_tenant_breakdown": _with(
        RANKED,
        f"""SELECT 'class' AS grouping, CASE WHEN {_POS} THEN 'match' ELSE 'abstain' END AS name, count(*) AS n, {_n("decision = 'auto'", 'auto')}, {_n(f"decision = 'auto' AND {_OK}", 'auto_correct')} FROM decided GROUP BY 2
        UNION ALL SELECT 'tenant', tenant, count(*), {_n("decision = 'auto'", 'auto')}, {_n(f"decision = 'auto' AND {_OK}", 'auto_correct')} FROM decided GROUP BY 2""",
    ),
    "identifier_diagnosis": _with(
        RANKED,
        f"""SELECT CASE WHEN source = 'identifier_conflict' THEN 'identifier_conflict' WHEN {_STRONG} AND {_OK} THEN 'identifier_correct' WHEN {_STRONG} THEN 'identifier_wrong' ELSE 'true_lexical_error' END AS diagnosis, count(*) AS n
        FROM decided JOIN (SELECT line_id, item_code AS fuzzy FROM lexical) x USING (line_id) WHERE {_POS} AND fuzzy <> gt_item_code GROUP BY 1""",
    ),
    "auto_errors": _with(RANKED, f"SELECT line_id, tenant, source, item_code, gt_item_code, round(confidence, 6) AS confidence FROM decided WHERE decision = 'auto' AND NOT {_OK}"),
    "no_match_errors": _with(RANKED, f"SELECT line_id, tenant, gt_item_code, round(confidence, 6) AS confidence FROM decided WHERE decision = 'no_match' AND {_POS}"),
    "retrieval_scores": _with(
        RANKED,
        f"""SELECT {_n('rank = 1', 'n_lines')}, {_n('rank = 1 AND item_code = gt_item_code', 'top1')}, {_n('rank <= 5 AND item_code = gt_item_code', 'top5')},
        round(avg(CASE WHEN rank = 1 AND item_code = gt_item_code THEN confidence_score END), 6) AS avg_score_right, round(avg(CASE WHEN rank = 1 AND item_code <> gt_item_code THEN confidence_score END), 6) AS avg_score_wrong FROM ranked WHERE {_POS}""",
    ),
    "retrieval_misses": _with(
        RANKED | {"ahead": "SELECT line_id, item_code AS first_code FROM ranked WHERE rank = 1", "place": "SELECT line_id, CAST(min(rank) AS INTEGER) AS gt_rank FROM ranked WHERE item_code = gt_item_code GROUP BY 1"},
        f"SELECT l.line_id, l.gt_item_code, b.first_code, p.gt_rank FROM line l LEFT JOIN ahead b USING (line_id) LEFT JOIN place p USING (line_id) WHERE l.{_POS} AND p.gt_rank IS DISTINCT FROM 1",
    ),
    "blank_candidates": _with(RANKED, f"SELECT x.line_id, x.item_code, x.codes[2] AS second_code, round(x.confidence, 6) AS confidence, round(x.margin, 6) AS margin FROM lexical x JOIN line l USING (line_id) WHERE NOT (l.{_POS})"),
    "blank_examples": _with(RANKED, f"SELECT line_id, l.raw_text, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM lexical x JOIN line l USING (line_id) WHERE NOT (l.{_POS}) ORDER BY x.confidence, x.margin, line_id LIMIT 20"),
    "failure_drilldown": _with(
        RANKED,
        f"""SELECT r.line_id, l.raw_text, r.gt_item_code, g.item_name AS gt_name, g.list_price AS gt_price, CAST(r.rank AS INTEGER) AS rank, r.item_code, i.item_name, i.list_price, round(r.lex, 6) AS lexical_score, round(r.rank_score, 6) AS rank_score
        FROM ranked r JOIN line l USING (line_id) JOIN catalogue i ON i.tenant = l.tenant AND i.item_code = r.item_code LEFT JOIN catalogue g ON g.tenant = l.tenant AND g.item_code = r.gt_item_code
        WHERE r.rank <= 5 AND r.line_id IN (SELECT line_id FROM ranked WHERE {_POS} AND rank = 1 AND item_code <> gt_item_code)""",
    ),
    "price_examples": _with(
        RANKED | {"off": f"SELECT r.line_id, r.item_code, r.gt_item_code, r.rank, abs(r.unit_price - i.list_price) / i.list_price AS off FROM ranked r JOIN active i ON i.item_code = r.item_code WHERE r.{_POS} AND r.unit_price > 0 AND i.list_price > 0"},
        "SELECT a.line_id, a.item_code AS first_code, a.gt_item_code, round(a.off, 6) AS first_off, round(b.off, 6) AS gt_off FROM off a JOIN off b USING (line_id) WHERE a.rank = 1 AND a.item_code <> a.gt_item_code AND b.item_code = b.gt_item_code AND b.off + 0.10::DOUBLE < a.off",
    ),
    "uom_confident_pairs": _with(
        RANKED | {
            "uoms": "SELECT tenant, item_code, 'pcs' AS uom FROM active UNION ALL SELECT tenant, item_code, CASE row_ord % 2 WHEN 0 THEN 'ctn' ELSE 'box' END FROM active",
            "tops": "SELECT line_id, max(CASE WHEN lex_rank = 1 THEN item_code END) AS item_code, max(CASE WHEN lex_rank = 1 THEN lex END) AS one, coalesce(max(CASE WHEN lex_rank = 2 THEN lex END), 0.0::DOUBLE) AS two FROM ranked GROUP BY 1",
        },
        "SELECT l.uom_text, u.uom AS item_uom, count(*) AS n FROM tops t JOIN line l USING (line_id) JOIN uoms u ON u.tenant = l.tenant AND u.item_code = t.item_code WHERE t.one >= 0.95::DOUBLE AND t.one - t.two >= 0.02::DOUBLE AND l.uom_text <> '' GROUP BY 1, 2",
    ),
    "price_signal": _with(
        RANKED | {
            "priced": f"SELECT r.item_code = r.gt_item_code AS hit, abs(r.unit_price - c.list_price) / c.list_price AS off FROM ranked r JOIN line l ON l.line_id = r.line_id JOIN catalogue c ON c.tenant = l.tenant AND c.item_code = r.gt_item_code WHERE r.rank = 1 AND r.{_POS} AND r.unit_price > 0 AND c.list_price > 0",
            "flat": "SELECT 'all' AS outcome, off FROM priced UNION ALL SELECT CASE WHEN hit THEN 'first_right' ELSE 'first_wrong' END, off FROM priced",
        },
        f"SELECT outcome, count(*) AS n, round(median(off), 4) AS median_off, {_n('off <= 0.1::DOUBLE', 'within_10')}, {_n('off <= 0.25::DOUBLE', 'within_25')}, {_n('off <= 0.5::DOUBLE', 'within_50')} FROM flat GROUP BY 1",
    ),
    "predictions_validation": _with(
        RANKED | {
            "rows0": _PREDICTED,
            "turned": "SELECT *, CASE WHEN CAST(line_id AS BIGINT) % 600 = 0 THEN (CAST(line_id AS BIGINT) // 600) % 5 ELSE -1 END AS turn FROM rows0",
            "spoilt": """SELECT line_id, CASE turn WHEN 0 THEN '' WHEN 1 THEN 'P999999' ELSE item_code END AS item_code, CASE turn WHEN 2 THEN '1.5' ELSE confidence END AS confidence, CASE turn WHEN 3 THEN 'maybe' ELSE decision END AS decision,
                reason_code, CASE turn WHEN 4 THEN 'P000001:0.9|P000002:2.0|:0.1|P000003:0.2' ELSE candidates END AS candidates FROM turned""",
            "parts": "SELECT *, list_filter(string_split(candidates, '|'), lambda x: x <> '') AS p, TRY_CAST(confidence AS DOUBLE) AS s FROM spoilt",
        },
        """SELECT line_id, 'bad_decision' AS violation FROM parts WHERE decision NOT IN ('auto', 'review', 'reject')
        UNION ALL SELECT line_id, 'bad_confidence' FROM parts WHERE s IS NULL OR s < 0 OR s > 1
        UNION ALL SELECT line_id, 'auto_without_item' FROM parts WHERE decision = 'auto' AND trim(item_code) = ''
        UNION ALL SELECT line_id, 'item_without_auto' FROM parts WHERE decision <> 'auto' AND trim(item_code) <> ''
        UNION ALL SELECT line_id, 'too_many_candidates' FROM parts WHERE len(p) > 3
        UNION ALL SELECT line_id, 'bad_candidate' FROM parts WHERE len(list_filter(p, lambda x: regexp_extract(x, '^(.*):([^:]*)$', 1) = '' OR coalesce(TRY_CAST(regexp_extract(x, '^(.*):([^:]*)$', 2) AS DOUBLE), -1) NOT BETWEEN 0 AND 1)) > 0
        UNION ALL SELECT line_id, 'foreign_item' FROM parts WHERE len(list_filter(list_concat(list_transform(p, lambda x: regexp_extract(x, '^(.*):([^:]*)$', 1)), CASE WHEN item_code <> '' THEN [item_code] ELSE [] END), lambda x: NOT starts_with(x, 'P'))) > 0""",
    ),
}

# -- data health

_UOM = {
    "uoms": "SELECT tenant, item_code, 'pcs' AS uom, 1.0::DOUBLE AS conversion_factor, 1 AS is_stock_uom FROM active UNION ALL SELECT tenant, item_code, CASE row_ord % 2 WHEN 0 THEN 'ctn' ELSE 'box' END, CAST(row_ord % 12 + 1 AS DOUBLE), 0 FROM active"
}
_WORDSET = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: len(x) > 1))"
ORACLES |= {
    "catalogue_health": _with(
        CATALOGUE | ALIAS,
        f"""SELECT c.*, coalesce(a.n_mappings, 0) AS n_mappings, coalesce(a.n_expired, 0) AS n_expired, coalesce(a.n_low_confidence, 0) AS n_low_confidence FROM
        (SELECT tenant, count(*) AS n_items, {_n("disabled = '1'", 'n_disabled')}, {_n("barcode = ''", 'n_no_barcode')}, {_n("item_code LIKE '%-OLD'", 'n_superseded')}, count(*) - count(DISTINCT item_code) AS n_repeated, {_n("disabled = '0' AND available_qty = 0", 'n_zero_stock')} FROM catalogue GROUP BY 1) c
        LEFT JOIN (SELECT tenant, count(*) AS n_mappings, {_n("valid_to <> '' AND valid_to < '1998-01-01'", 'n_expired')}, {_n('confidence < 1', 'n_low_confidence')} FROM alias GROUP BY 1) a USING (tenant)""",
    ),
    "signal_availability": _with(_LINE, f"SELECT tenant, count(*) AS n_lines, {_n("buyer_sku <> ''", 'n_buyer_sku')}, {_n("raw_barcode <> ''", 'n_raw_barcode')}, {_n('unit_price IS NOT NULL', 'n_unit_price')}, {_n("uom_text <> ''", 'n_uom_text')} FROM line GROUP BY 1"),
    "identifier_quality": _with(
        _WIDE,
        " UNION ALL ".join(
            f"SELECT '{lane}' AS lane, count(*) AS asked, count(x.item_code) AS resolved, count(*) FILTER (WHERE x.item_code = l.gt_item_code) AS \"right\", count(*) FILTER (WHERE x.item_code IS NOT NULL AND x.item_code IS DISTINCT FROM l.gt_item_code) AS wrong FROM line l LEFT JOIN {lane}_lane x ON x.line_id = l.line_id WHERE l.{column} <> ''"
            for lane, column in (("barcode", "raw_barcode"), ("alias", "buyer_sku"))
        ),
    ),
    "gt_missing": _with(_LINE | CATALOGUE, "SELECT line_id, tenant, gt_item_code AS item_code FROM line l WHERE gt_item_code <> '' AND NOT EXISTS (SELECT 1 FROM active a WHERE a.tenant = l.tenant AND a.item_code = l.gt_item_code)"),
    "foreign_skus": _with(
        _LINE | CATALOGUE | {"asked": "SELECT line_id, tenant, 'P' || lpad(CAST(CAST(substr(gt_item_code, 2) AS BIGINT) + 1 AS VARCHAR), 6, '0') AS buyer_sku FROM line WHERE gt_item_code <> ''"},
        "SELECT * FROM asked l WHERE EXISTS (SELECT 1 FROM catalogue c WHERE c.item_code = l.buyer_sku AND c.tenant <> l.tenant)",
    ),
    "brand_frequency": _with(CATALOGUE, "SELECT tenant, brand, count(*) AS n FROM catalogue GROUP BY 1, 2"),
    "duplicate_names": _with(CATALOGUE, "SELECT tenant, item_name, count(*) AS n FROM active GROUP BY 1, 2 HAVING count(*) > 1"),
    "bulk_twins": _with(
        CATALOGUE | {"plain": f"SELECT tenant, {norm('item_name')} AS base, arg_min(item_code, [CAST(row_ord AS VARCHAR).lpad(12, '0'), item_code]) AS base_code FROM catalogue GROUP BY 1, 2"},
        f"SELECT c.tenant, c.item_code || 'B' AS item_code, p.base_code FROM catalogue c LEFT JOIN plain p ON p.tenant = c.tenant AND p.base = {norm('c.item_name')} WHERE c.row_ord % 10 = 3 AND c.disabled = '0'",
    ),
    "bulk_labels": _with(
        _LINE | CATALOGUE | {
            "asked": "SELECT tenant, CASE WHEN line_id % 4 = 0 THEN raw_text || ' bulk' ELSE raw_text END AS raw_text, gt_item_code, line_id % 2 = 0 AS even FROM line WHERE gt_item_code <> ''",
            "labelled": "SELECT q.raw_text, a.row_ord % 10 = 3 AND even AS bulk FROM asked q JOIN active a ON a.tenant = q.tenant AND a.item_code = q.gt_item_code",
        },
        f"SELECT {_n('NOT bulk', 'n_base')}, {_n('bulk', 'n_bulk')}, {_n(f"bulk AND NOT list_contains(string_split({norm('raw_text')}, ' '), 'bulk')", 'n_bulk_unsaid')} FROM labelled",
    ),
    "uom_reference_explode": _with(CATALOGUE | _UOM, "SELECT * FROM uoms"),
    "uom_pairs": _with(_LINE | CATALOGUE | _UOM, "SELECT l.uom_text, u.uom AS item_uom, count(*) AS n FROM line l JOIN uoms u ON u.tenant = l.tenant AND u.item_code = l.gt_item_code WHERE l.uom_text <> '' GROUP BY 1, 2"),
    "label_hygiene": _with(
        {"line": _line()} | CATALOGUE | {"lw": f"SELECT line_id, tenant, {_WORDSET.format('raw_text')} AS w FROM line", "iw": f"SELECT tenant, item_code, {_WORDSET.format('item_name')} AS w FROM active"},
        "SELECT l.line_id, count(*) AS n_items FROM lw l JOIN iw i ON i.tenant = l.tenant AND list_has_all(i.w, l.w) WHERE len(l.w) > 0 GROUP BY 1 HAVING count(*) > 1",
    ),
}

# -- synchronisation

FEED = {"feed": "SELECT user_id AS external_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS version, date_trunc('minute', ts) AS updated_at, event_type, value FROM events"}
SYNC = FEED | {
    "newest": "SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY version DESC) = 1",
    "seen": f"SELECT * FROM feed WHERE updated_at < TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY version DESC) = 1",
    "store": """SELECT external_id, event_type, CASE WHEN external_id % 3 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN external_id % 10 = 0 THEN NULL ELSE version END AS remote_version,
        CASE WHEN external_id % 6 = 0 THEN TIMESTAMP '2024-02-15 00:00:00' ELSE updated_at END AS updated_at_utc, external_id % 3 = 0 AS dirty, CASE WHEN external_id % 3 = 0 THEN 1 ELSE 0 END AS mutation_id FROM seen""",
}
_KEEP = "(r.version IS NULL OR (s.external_id IS NOT NULL AND ((NOT s.dirty AND coalesce(s.remote_version = r.version, FALSE)) OR (s.dirty AND s.updated_at_utc > r.updated_at))))"
_CLASSIFIED = """SELECT s.external_id, CASE WHEN s.remote_version IS NULL AND r.version IS NULL THEN 'create' WHEN s.remote_version IS NULL AND s.event_type = r.event_type AND s.value = r.value THEN 'reconcile_create'
                WHEN s.remote_version IS NULL THEN 'create_conflict' WHEN s.remote_version = r.version THEN 'update' WHEN s.event_type = r.event_type AND s.value = r.value THEN 'reconcile_update' ELSE 'update_conflict' END AS outcome, r.version AS v
                FROM store s LEFT JOIN (SELECT * FROM newest WHERE external_id % 20 <> 0) r ON r.external_id = s.external_id WHERE s.dirty"""
ORACLES |= {
    "sync_pull_page": _with(FEED, "SELECT * FROM feed WHERE updated_at > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 MINUTE ORDER BY updated_at, external_id, version LIMIT 50"),
    "sync_pull_latest": _with(SYNC, "SELECT * FROM newest"),
    "sync_stream_pull": _with(SYNC, "SELECT * FROM newest"),
    "sync_pull_merge": _with(
        SYNC,
        f"""SELECT coalesce(s.external_id, r.external_id) AS external_id, CASE WHEN {_KEEP} THEN s.event_type ELSE r.event_type END AS event_type, CASE WHEN {_KEEP} THEN s.value ELSE r.value END AS value,
        CASE WHEN {_KEEP} THEN s.remote_version ELSE r.version END AS remote_version, CASE WHEN {_KEEP} THEN s.updated_at_utc ELSE r.updated_at END AS updated_at_utc, CASE WHEN {_KEEP} THEN s.dirty ELSE FALSE END AS dirty,
        coalesce(s.mutation_id, 0) AS mutation_id FROM store s FULL JOIN newest r ON r.external_id = s.external_id""",
    ),
    "sync_push_classify": _with(
        SYNC | {
            "classified": _CLASSIFIED
        },
        "SELECT external_id, outcome, CAST(CASE WHEN outcome IN ('create', 'update') THEN coalesce(v, 0) + 1 ELSE v END AS INTEGER) AS version FROM classified",
    ),
    "sync_acknowledge": _with(
        SYNC | {"classified": _CLASSIFIED},
        """SELECT s.external_id, CAST(CASE WHEN c.external_id IS NULL OR c.outcome LIKE '%conflict' THEN s.remote_version WHEN c.outcome IN ('create', 'update') THEN coalesce(c.v, 0) + 1 ELSE c.v END AS INTEGER) AS remote_version,
        s.dirty AND coalesce(c.outcome LIKE '%conflict', FALSE) AS dirty FROM store s LEFT JOIN classified c USING (external_id)""",
    ),
    "sync_both_ways": _with(
        SYNC | {
            "pulled": f"""SELECT coalesce(s.external_id, r.external_id) AS external_id, CASE WHEN {_KEEP} THEN s.event_type ELSE r.event_type END AS event_type, CASE WHEN {_KEEP} THEN s.value ELSE r.value END AS value,
                CASE WHEN {_KEEP} THEN s.remote_version ELSE r.version END AS remote_version, CASE WHEN {_KEEP} THEN s.updated_at_utc ELSE r.updated_at END AS updated_at_utc, CASE WHEN {_KEEP} THEN s.dirty ELSE FALSE END AS dirty,
                coalesce(s.mutation_id, 0) AS mutation_id, r.version AS now, r.event_type IS NOT DISTINCT FROM s.event_type AND r.value IS NOT DISTINCT FROM s.value AS same FROM store s FULL JOIN newest r ON r.external_id = s.external_id""",
        },
        """SELECT external_id, event_type, value, CASE WHEN dirty AND remote_version = now THEN now + 1 WHEN dirty AND now IS NULL THEN 1 WHEN dirty AND same THEN now ELSE remote_version END AS remote_version,
        updated_at_utc, dirty AND now IS NOT NULL AND remote_version IS DISTINCT FROM now AND NOT same AS dirty, mutation_id FROM pulled""",
    ),
    "erp_apply_writes": _with(
        SYNC,
        """SELECT s.external_id, CASE WHEN s.external_id % 9 = 0 THEN 'replay' WHEN coalesce(s.remote_version, 0) = coalesce(r.version, 0) THEN 'ok' ELSE 'conflict' END AS status,
        CAST(CASE WHEN s.external_id % 9 = 0 THEN 77 WHEN coalesce(s.remote_version, 0) = coalesce(r.version, 0) THEN coalesce(r.version, 0) + 1 ELSE r.version END AS INTEGER) AS version
        FROM store s LEFT JOIN (SELECT * FROM newest WHERE external_id % 20 <> 0) r USING (external_id) WHERE s.dirty""",
    ),
    "idempotency_keys": _with(SYNC, """SELECT external_id, substr(sha256('{"id": "' || CAST(external_id AS VARCHAR) || '", "mutation_id": ' || CAST(mutation_id AS VARCHAR) || '}'), 1, 32) AS idempotency_key FROM store WHERE dirty"""),
    "sync_invariants": _with(
        SYNC,
        f"""SELECT {_n('s.external_id IS NULL', 'missing')}, {_n('NOT s.dirty AND s.remote_version < r.version', 'stale')}, {_n('NOT s.dirty AND s.remote_version = r.version AND s.value IS DISTINCT FROM r.value', 'drifted')},
        (SELECT count(*) FROM (SELECT 1 FROM feed GROUP BY external_id, version HAVING count(*) > 1)) AS written_twice FROM store s FULL JOIN newest r ON r.external_id = s.external_id""",
    ),
    "erp_utc_normalise": _with(FEED, "SELECT external_id, version, updated_at - INTERVAL 8 HOUR AS updated_at_utc FROM feed"),
}
