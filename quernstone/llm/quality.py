"""A quality classifier as a sparse ensemble of rules.

1. Statistics of the text are column expressions.
2. Small regression trees are boosted on a bounded sample of labelled rows;
   each path from a root to a node is a rule, a conjunction of bounds on
   statistics.
3. Logistic regression with a lasso penalty weighs the rules; most get none.
4. The rules that stay compile into one column expression, so scoring is a
   scan: no join, no shuffle, no Python on the executors.

Defined results: a null text counts as empty and gets a score like any text;
labels that are null take no part; without labels of both kinds every text gets
the share of good labels (0.5 without any); repeated rows each get their score;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, need, text_or_empty

#: Most labelled rows that the classifier is fitted on, those of smallest id hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """The text's statistics in two layers: counts that read the text, and what follows from them."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text).cast("double"),
        "words": F.regexp_count(text, F.lit(WORD)).cast("double"),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
        "digits": F.regexp_count(text, F.lit("[0-9]")).cast("double"),
        "marks": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,']")).cast("double"),
        "stops": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")).cast("double"),
        "commas": F.regexp_count(text, F.lit(",")).cast("double"),
        "runs": F.regexp_count(text, F.lit(r"([^\p{L}\p{N}\s.])\1+")).cast("double"),
        "shouts": F.regexp_count(text, F.lit(r"\p{Lu}{2,}")).cast("double"),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "short_words": F.regexp_count(text, F.lit(r"(?<![^\s])\S{1,3}(?![^\s])")).cast("double"),
    }


def features(col: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What rules may bound, from the columns of ``statistics``."""

    def _per(a: str, b: str) -> Column:
        return col(a) / F.greatest(col(b), F.lit(1.0))

    return {
        "f_words": col("words"),
        "f_word_length": _per("chars", "words"),
        "f_upper": _per("upper", "chars"),
        "f_digits": _per("digits", "chars"),
        "f_marks": _per("marks", "chars"),
        "f_stops": _per("stops", "words"),
        "f_commas": _per("commas", "words"),
        "f_runs": _per("runs", "words"),
        "f_shouts": _per("shouts", "words"),
        "f_line_words": _per("words", "lines"),
        "f_line_share": _per("distinct_lines", "lines"),
        "f_word_share": _per("distinct_words", "words"),
        "f_short_words": _per("short_words", "words"),
    }


FEATURES = [
    "f_words", "f_word_length", "f_upper", "f_digits", "f_marks", "f_stops", "f_commas", "f_runs", "f_shouts", "f_line_words", "f_line_share", "f_word_share", "f_short_words",
]


def with_features(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    held = df.select(*keep, text_or_empty(text_col).alias("__text"))
    counted = held.select(*keep, *(x.alias(name) for name, x in statistics(F.col("__text")).items()))
    return counted.select(*keep, *(x.alias(name) for name, x in features().items()))


#: A rule: (feature, is it above the bound, bound), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, col: Callable[[str], Column] = F.col) -> Column:
        """The score as an expression over the feature columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = None
            for feature, above, bound in rule:
                x = col(FEATURES[feature])
                one = x > F.lit(float(bound)) if above else x <= F.lit(float(bound))
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x):
        """The same over a matrix."""
        import numpy as np

        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _holds(x, rule)
        return 1.0 / (1.0 + np.exp(-total))


def _holds(x, rule: Rule):
    import numpy as np

    out = np.ones(len(x), dtype=bool)
    for feature, above, bound in rule:
        out &= x[:, feature] > bound if above else x[:, feature] <= bound
    return out


def _best_split(codes, residual, edges, least: int):
    """The split of largest gain in squared error: (feature, bound, gain), from counts per bin."""
    import numpy as np

    n, total = len(residual), residual.sum()
    best = (None, 0.0, 1e-9)
    for f, bounds in enumerate(edges):
        if not len(bounds):
            continue
        count = np.cumsum(np.bincount(codes[:, f], minlength=len(bounds) + 1))[:-1]
        got = np.cumsum(np.bincount(codes[:, f], residual, len(bounds) + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = got**2 / count + (total - got) ** 2 / (n - count) - total**2 / n
        gain[(count < least) | (n - count < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[2]:
            best = (f, float(bounds[k]), float(gain[k]))
    return best


def tree_rules(x, y, trees: int = 40, depth: int = 3, bins: int = 48, rate: float = 0.2, least: int = 10, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, each fitted to the residuals over half of the rows and half of the features."""
    import numpy as np

    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(edges)], axis=1)
    score, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        use = rng.random(len(y)) < 0.5
        some = [b if rng.random() < 0.6 else b[:0] for b in edges]
        open_: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), bool))]
        for level in range(depth + 1):
            following = []
            for rule, here in open_:
                own = here & use
                if level < depth and own.sum() >= 2 * least:
                    f, bound, _ = _best_split(codes[own], residual[own], some, least)
                    if f is not None:
                        above = x[:, f] > bound
                        for side in (False, True):
                            path = tuple(sorted({**{(p[0], p[1]): p for p in rule}, (f, side): (f, side, bound)}.values()))
                            rules[path] = None
                            following.append((path, here & (above == side)))
                        continue
                if own.any():
                    p = 1 / (1 + np.exp(-score[own]))
                    score[here] += rate * residual[own].sum() / max(1e-3, (p * (1 - p)).sum())
            open_ = following
    return list(rules)


def lasso(z, y, penalty: float, steps: int = 400):
    """Logistic regression with an L1 penalty by accelerated proximal gradients: (intercept, weights)."""
    import numpy as np

    n, m = z.shape
    z1 = np.column_stack([np.ones(n), z]).astype(np.float64)
    v = np.ones(m + 1)
    for _ in range(30):  # the largest eigenvalue bounds the step
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    step = 4.0 * n / (np.linalg.norm(z1 @ v) ** 2 + 1e-9)
    w = np.zeros(m + 1)
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slope = z1.T @ (1 / (1 + np.exp(-(z1 @ ahead))) - y) / n
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return float(w[0]), w[1:]


def fit_matrix(x, y, penalty: float = 0.001, **options) -> RuleModel:
    import numpy as np

    good = np.isfinite(x).all(axis=1)
    x, y = x[good], y[good].astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y, **options)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))))
    z = np.stack([_holds(x, r) for r in rules], axis=1)
    # rules that hold on the same rows say the same
    _, first = np.unique(np.packbits(z, axis=0), axis=1, return_index=True)
    first.sort()
    intercept, weights = lasso(z[:, first], y, penalty)
    return RuleModel(intercept, [(rules[k], float(w)) for k, w in zip(first, weights) if abs(w) > 1e-6])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows (already without the held-out ones)."""
    import numpy as np

    need(df, id_col, text_col)
    need(labels, id_col, label_col)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    # at most sample_rows small rows, so they may go to all workers
    chosen = chosen.orderBy(F.xxhash64("__id", F.lit(17)), "__y").limit(sample_rows)
    rows = df.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(text_col, "__y")
    found = with_features(rows, text_col, ["__y"]).orderBy(*FEATURES, "__y").limit(2 * sample_rows).toPandas().to_numpy(dtype=np.float64)
    return fit_matrix(found[:, 1:], found[:, 0], **options)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def score(df: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted for every row."""
    need(df, id_col, text_col)
    scored = with_features(df, text_col, [id_col]).select(id_col, model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def keep(df: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the model accepts, with the columns of ``df``."""
    need(df, text_col)
    # bound one after the other inside one expression, so a filter that moves to the scan still reads the text once
    counts = F.struct(*(x.alias(name) for name, x in statistics(text_or_empty(text_col)).items()))
    values = F.transform(F.array(counts), lambda c: F.struct(*(x.alias(name) for name, x in features(lambda n: c[n]).items())))
    score_ = F.transform(values, lambda v: model.column(lambda n: v[n]))
    return df.where(F.get(score_, F.lit(0)) >= threshold)
