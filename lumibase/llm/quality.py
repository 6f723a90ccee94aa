"""A quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded sample of labelled documents. Every path from a root to a node is a rule: a
conjunction of thresholds on statistics. A logistic regression with an L1 penalty weighs the rules and drops most of
them; what is left is compiled to one Spark column expression over the statistics' columns.

Defined results: a null or empty text has statistics of zero and gets a score like any other text. Labels that are
null, or whose document is missing, teach nothing; of several labels of a document the largest counts. Without
labelled documents the score is 0.5 everywhere, with labels of one kind their value. Repeated rows get equal scores;
null ids and all other columns are kept, whatever their names (only one named like the score is replaced). An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumibase.llm.shared import small_batches, text_or_empty

STATISTICS = (
    "distinct_words", "commonest_word", "repeated_next", "distinct_lines", "upper", "digits", "marks", "symbols",
    "word_length", "blank", "lines_per_word", "marked_words",
)
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b".,;:!?'\"()-"
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in MARKS)
BLANKS = b" \t\n\r"


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of a text, as shares unless the name says otherwise."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    raw, n = text.encode(), len(words)
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / len(raw)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return (
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        share(UPPER),
        share(DIGITS),
        share(MARKS),
        share(SYMBOLS),
        sum(map(len, words)) / n,
        share(BLANKS),
        len(lines) / n,
        sum(not w[-1].isalnum() for w in words) / n,
    )


def with_statistics(df: DataFrame, text_col: str = "text", prefix: str = "_stat_") -> DataFrame:
    """Adds a column for each statistic; names are prefixed, and a column of that name is replaced."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if not f.name.startswith(prefix)]
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), text_or_empty(text_col).alias(f"{prefix}text"))
    schema = StructType([*kept, *(StructField(prefix + s, DoubleType()) for s in STATISTICS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t) for t in batch.column(len(kept)).to_pylist()], float).reshape(-1, len(STATISTICS))
            columns = [*batch.columns[: len(kept)], *(pa.array(c) for c in made.T)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *(prefix + s for s in STATISTICS)])

    return rows.mapInArrow(work, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str, text_col: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """_label and text of at most ``most`` documents, the first by a hash of the id, without the held-out fold. Of the
    rows of one id the one with the least hash of its text stands for all."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), modulus) != held_out))
    chosen = own.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id")  # at most `most` rows
    one = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), "_text")).alias("least"))
    return one.select("_label", F.col("least._text").alias(text_col))


def fold(id_: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(modulus))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold), and its weight."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, k] > t) == above for k, above, t in self.conditions])


def _grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, depth: int, path: tuple = ()) -> Iterator[tuple]:
    """Paths to all nodes of a regression tree on the residuals; leaves come with the rows and their mean."""
    best = None
    if depth:
        total, n = residual.sum(), len(residual)
        for k, thresholds in enumerate(cuts):
            for t in thresholds:
                above = x[:, k] > t
                m = int(above.sum())
                if min(m, n - m) < 5:
                    continue
                s = residual[above].sum()
                gain = s * s / m + (total - s) ** 2 / (n - m) - total * total / n
                if best is None or gain > best[0]:
                    best = gain, k, float(t)
    if best is None or best[0] < 1e-6:
        yield path, True
        return
    if path:
        yield path, False
    _, k, t = best
    for above in (True, False):
        side = (x[:, k] > t) == above
        yield from _grow(x[side], cuts, residual[side], depth - 1, (*path, (k, above, t)))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps; the intercept is free."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rate = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 12, depth: int = 3, penalty: float = 0.0005) -> tuple[list[Rule], float]:
    """The weighted rules and the intercept."""
    if len(y) == 0:
        return [], 0.0
    if y.min() == y.max():
        return [], 8.0 if y[0] else -8.0
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25))) for k in range(x.shape[1])]
    found: dict[tuple, None] = {}
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        for path, leaf in _grow(x, cuts, residual, depth):
            if path:
                found[path] = None
                if leaf:
                    rows = Rule(path).holds(x)
                    p = 1 / (1 + np.exp(-score[rows]))
                    score[rows] += 0.5 * residual[rows].sum() / (np.maximum(p * (1 - p), 1e-3).sum())
    rules = [Rule(path) for path in found]
    if not rules:
        return [], float(score[0])
    weights, intercept = _lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(float), y, penalty)
    return [Rule(r.conditions, float(w)) for r, w in zip(rules, weights, strict=True) if w], intercept


def compiled(rules: list[Rule], intercept: float, prefix: str = "_stat_") -> Column:
    """The score as a column expression: the logistic sum of the weights of the rules that hold."""

    def one(rule: Rule) -> Column:
        tests = [F.col(prefix + STATISTICS[k]) > t if above else F.col(prefix + STATISTICS[k]) <= t for k, above, t in rule.conditions]
        return F.when(reduce(Column.__and__, tests), F.lit(rule.weight)).otherwise(F.lit(0.0))

    total = reduce(Column.__add__, map(one, rules), F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 5,
    held_out: int = 0,
    most_labelled: int = 10_000,
    out: str = "score",
) -> DataFrame:
    """Adds the score: how likely the label is 1. The rules are learned from at most ``most_labelled`` documents, none
    of the held-out fold (``crc32(id) mod modulus = held_out``)."""
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, modulus=modulus, held_out=held_out, most=most_labelled)
    rows = with_statistics(sample.withColumn("_label", F.col("_label").cast("double")), text_col).drop(text_col).toArrow()
    table = np.column_stack([c.to_numpy() for c in rows.columns]) if rows.num_rows else np.empty((0, 1 + len(STATISTICS)))
    table = table[np.lexsort(table.T)]  # the order of the rows must not matter
    rules, intercept = fit_rules(table[:, 1:], (table[:, 0] > 0).astype(float))
    scored = with_statistics(as_row(docs), f"row.`{text_col}`")
    return scored.select(*row_columns(docs, out), compiled(rules, intercept).alias(out))


def as_row(docs: DataFrame) -> DataFrame:
    """All columns as one, ``row``, so that none of a caller's names meets ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def row_columns(docs: DataFrame, out: str) -> list[Column]:
    """The caller's columns out of ``row`` but for the one named ``out``."""
    return [F.col(f"row.`{c}`") for c in docs.columns if c != out]
