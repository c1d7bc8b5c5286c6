"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Boosted shallow trees over a bounded labelled sample propose rules: every path
from a root to a node is a conjunction of thresholds. A logistic regression
with an L1 penalty keeps few of them. The kept rules become one Spark column
expression, so scoring is a projection next to the scan: no Python worker, no
shuffle, and a rule can be read (``QualityRules.describe``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspan.llm._sample import bounded
from roadspan.llm._scratch import unused

SAMPLE = 3000  # most labelled texts of each label that are learned from
TREES, DEPTH, BINS, SHRINKAGE = 40, 3, 48, 0.3
LEAST = 8  # texts below a node
PENALTIES = (0.03, 0.01, 0.003, 0.001)  # of the L1 norm, per text
STEPS = 400
SEED = 5
LIMIT = 30.0  # of the log-odds: no score is exactly 0 or 1


def _pieces(text: Column) -> dict[str, Column]:
    """What several statistics share: the text (null: empty), its words, its lines and its marks alone."""
    text = F.coalesce(text, F.lit(""))
    return {
        "text": text,
        "words": F.array_remove(F.split(text, r"\s+"), ""),
        "lines": F.array_remove(F.split(text, "\n"), ""),
        "marks": F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""),
    }


def _measures(piece: Callable[[str], Column]) -> dict[str, Column]:
    text, words, lines, marks = map(piece, ("text", "words", "lines", "marks"))
    chars, n, m, solid = F.length(text), F.size(words), F.size(lines), F.length(F.array_join(words, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return {
        "words": n.cast("double"),
        "word_length": share(solid, n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "repeated_next": share(F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1))), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), m),
        "line_words": share(n, m),
        "upper": share(F.length(F.regexp_replace(text, r"\P{Lu}+", "")), chars),
        "digits": share(F.length(F.regexp_replace(text, r"\P{N}+", "")), chars),
        "marks": share(F.length(marks), chars),
        "symbols": share(F.length(F.regexp_replace(marks, r"[.,;:'\"()?-]+", "")), chars),
        "stops": share(F.length(F.regexp_replace(marks, r"[^.?]+", "")), n),
        "white": share(chars - solid, chars),
    }


#: Names of the statistics, in the order in which tables hold them.
STATISTICS = ("words", "word_length", "distinct_words", "repeated_next", "distinct_lines", "line_words", "upper", "digits", "marks", "symbols", "stops", "white")


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a struct column of statistics of each whole text; a null text has those of the empty one, which are all 0.

    Words are what white space parts, lines what line feeds part. Each takes
    time in proportion to the text; what several share is worked out once.
    """
    at = unused([*docs.columns, name], "pieces")
    both = docs.withColumn(at, F.struct(*(c.alias(n) for n, c in _pieces(F.col(f"`{text_col}`")).items())))
    found = _measures(lambda n: F.col(f"`{at}`.`{n}`"))
    return both.withColumn(name, F.struct(*(found[n].alias(n) for n in STATISTICS))).drop(at)


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` hold: (statistic, whether it is above, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stat: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, (stat[s] > t if above else stat[s] <= t for s, above, t in self.tests))

    def holds(self, table: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(table), bool)
        for s, above, t in self.tests:
            v = table[:, names.index(s)]
            out &= v > t if above else v <= t
        return out

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {t:g}" for s, above, t in self.tests)


@dataclass
class QualityRules:
    """Log-odds of label 1: ``intercept`` and a weight for every rule that holds."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self, stat: dict[str, Column]) -> Column:
        """Probability of label 1, rounded to six places. The sum is over an array, as one long sum would be too much generated code to be compiled."""
        terms = [F.when(r.column(stat), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules]
        z = F.aggregate(F.array(F.lit(self.intercept), *terms), F.lit(0.0), lambda a, b: a + b)
        return F.round(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(LIMIT)), F.lit(-LIMIT)))), 6)

    def describe(self) -> list[str]:
        """The rules by falling weight, as text."""
        return [f"{w:+.3f} if {r}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def _split(binned: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray) -> tuple[int, int] | None:
    """(statistic, last bin on the low side) of the split that gains most, or none."""
    best, found = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in features:
        b = binned[rows, f]
        low_g, low_h, low_n = (np.cumsum(np.bincount(b, w, BINS))[:-1] for w in (g[rows], h[rows], None))
        gain = low_g**2 / (low_h + 1) + (total_g - low_g) ** 2 / (total_h - low_h + 1) - total_g**2 / (total_h + 1)
        gain[(low_n < LEAST) | (len(rows) - low_n < LEAST)] = 0
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (int(f), at)
    return found


def paths(table: np.ndarray, names: list[str], labels: np.ndarray) -> list[Rule]:
    """Rules of all nodes of boosted trees, without those that hold for the same texts as an earlier, shorter one."""
    rng = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(table[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(len(names))]
    binned = np.stack([np.searchsorted(e, table[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    z = np.zeros(len(labels))
    found: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = labels - p, p * (1 - p)
        features = np.sort(rng.choice(len(names), max(1, len(names) * 2 // 3), replace=False))
        nodes = [(np.arange(len(labels)), ())]
        for depth in range(DEPTH + 1):
            below = []
            for rows, tests in nodes:
                if tests:
                    found.append(Rule(tests))
                cut = _split(binned, rows, g, h, features) if depth < DEPTH else None
                if cut is None:
                    z[rows] += SHRINKAGE * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                f, at = cut
                high = binned[rows, f] > at
                for part, above in ((~high, False), (high, True)):
                    below.append((rows[part], (*tests, (names[f], above, float(edges[f][at])))))
            nodes = below
    kept: dict[bytes, Rule] = {}
    for r in sorted(dict.fromkeys(found), key=lambda r: len(r.tests)):
        kept.setdefault(np.packbits(r.holds(table, names)).tobytes(), r)
    return list(kept.values())


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept, without a penalty) that minimise mean log-loss + penalty * L1 norm, by accelerated proximal steps."""
    a = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    step = 4 * len(y) / np.linalg.norm(a, 2) ** 2
    shrink = np.r_[np.full(x.shape[1], penalty * step), 0.0]
    ahead, t = w, 1.0
    for _ in range(STEPS):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ ahead, -LIMIT, LIMIT))) - y) / len(y)
        new = ahead - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.clip(x @ w[:-1] + w[-1], -LIMIT, LIMIT)
    return np.logaddexp(0, z) - y * z


def fit(table: np.ndarray, names: list[str], labels: np.ndarray) -> QualityRules:
    """Rules and weights from a table of statistics; rows in an order of their own give the same model as long as that order is the same.

    The penalty is the largest whose loss on every fifth row is within one
    standard error of the least one. Labels of one kind give no rules.
    """
    n1 = labels.sum()
    odds = float(np.log((n1 + 0.5) / (len(labels) - n1 + 0.5)))
    if not 0 < n1 < len(labels):
        return QualityRules(odds)
    rules = paths(table, names, labels)
    if not rules:
        return QualityRules(odds)
    x = np.stack([r.holds(table, names) for r in rules], axis=1).astype(float)
    apart = np.arange(len(labels)) % 5 == 4
    tried, w = [], None
    for penalty in PENALTIES:
        w = lasso(x[~apart], labels[~apart], penalty, w)
        each = _loss(x[apart], labels[apart], w) if apart.any() else np.zeros(1)
        tried.append((each.mean(), each.std() / np.sqrt(len(each))))
    least = min(tried)
    chosen = next(p for p, (mean, _) in zip(PENALTIES, tried, strict=True) if mean <= sum(least))
    w = lasso(x, labels, chosen)
    return QualityRules(float(w[-1]), [(r, float(v)) for r, v in zip(rules, w[:-1], strict=True) if v])


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of ids that nothing is learned from; null ids are not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityRules:
    """Fit on at most ``sample`` labelled texts of each label that aren't held out; only their statistics reach the driver.

    A document that is labelled more than once counts as bad if any label says
    so; of rows with one id, that with the smallest statistics is learned from.
    Null ids and labels are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).cast("int").alias("y"))
    kept = bounded(known.where("y > 0"), F.col("k"), sample).union(bounded(known.where("y <= 0"), F.col("k"), sample))
    # a few thousand ids: the join's small side, of a proven bound
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(kept), "k")
    rows = with_statistics(texts, "t", "s").groupBy("k", "y").agg(F.min("s").alias("s"))
    found = rows.select("k", "y", "s.*").toArrow()
    order = np.argsort(np.array([str(k) for k in found["k"].to_pylist()], dtype="U"), kind="stable")
    table = np.column_stack([found[n].to_numpy() for n in STATISTICS])[order]
    return fit(table, list(STATISTICS), (found["y"].to_numpy()[order] > 0).astype(float))


def score(docs: DataFrame, model: QualityRules, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the score (0 to 1, higher: label 1 likelier) of each whole text, from the text alone.

    Null and empty texts have the score of all statistics 0; equal texts have
    equal scores. A column of that name is replaced, all others stay, whatever
    their names. An empty table gives an empty result.
    """
    base = docs.drop(score_col)
    at = unused(base.columns, "statistics")
    found = with_statistics(base, text_col, at)
    return found.withColumn(score_col, model.column({n: F.col(f"`{at}`.`{n}`") for n in STATISTICS})).drop(at)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, learned from ``labels`` of documents that aren't held out.

    Every row is scored: see ``score`` for nulls, repeats and clashing names,
    ``train`` for what is learned from. Without labels of both kinds all scores
    are the share of what labels there are.
    """
    return score(docs, train(docs, labels, id_col, text_col), text_col)
