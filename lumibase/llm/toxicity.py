"""Toxicity by a weighted finite-state grammar of clauses.

Words become classes: insult (learned, with weights), threat (given verbs of violence), target, negation and reported
speech. Five transducers read a clause's classes side by side, composed to one machine whose transitions carry the
product of the factors:

- insult: an insult close behind another one is strengthened;
- threat: a verb of violence alone weighs little; it counts in full behind a target, or once its target follows;
- target: an insult behind a target is strengthened, and so is one that its target follows;
- negation: what follows a negation closely is softened;
- reported speech: what follows a verb of speech in its clause is softened.

A transition may also echo: add a multiple of what the clause's last insult or last threat has given, which is how a
target that comes behind the harm works. A clause's score is the sum along its path; no word counts outside of a
clause. The score of a document is a logistic function of its clauses' scores: the strongest, the second strongest, the
sum, the number of them and their share of all clauses.

Insults are learned from a bounded sample of labelled documents: words and word beginnings that toxic documents have
significantly more often. Near copies in the sample (equal least shingle hash) count once, so that the chance words of
a copied document teach nothing.

Defined results: a null or empty text has no clause and the score of a text without matches. Labels that are null, or
whose document is missing, teach nothing; without labelled toxic documents only the given threats match, and the
score of a text without matches is 0.05. Repeated rows get equal scores; null ids and all other columns are kept,
whatever their names (only one named like the score is replaced). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumibase.llm.quality import as_row, labelled_sample, row_columns
from lumibase.llm.shared import materialize, small_batches, text_or_empty

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = CLASSES = range(6)
#: Words of the closed classes in English, French, German and Spanish.
TARGETS = "you your yours yourself u ur he she they him her them tu toi te vous vos il elle ils du dich dir dein deine ihr euch sie er tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never nobody isn't aren't don't doesn't ne pas jamais aucun nicht kein keine nie niemals nunca jamás ningún".split()
REPORTS = "said says say called calls wrote writes claimed claims quoted reported dit disait écrit sagte sagt schrieb dijo dice escribió".split()
THREATS = "kill killed hurt destroy murder strangle stab shoot tuer détruire töten umbringen matar destruir".split()
#: The weight of a threat that has a target.
THREAT_WEIGHT = 4.0
CLAUSE = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"\w[\w']*")
#: Lengths of word beginnings that may be learned.
STEMS = (4, 5, 6, 7, 8)


Move = tuple[int, float, float, float]


@dataclass(frozen=True)
class Machine:
    """A transducer over classes: (state, class) -> (state, factor, echo of the last insult, echo of the last threat).
    The start is state 0; where there is no move, the state stays and the factor is 1."""

    states: int
    moves: dict[tuple[int, int], Move]

    def step(self, state: int, kind: int) -> Move:
        return self.moves.get((state, kind), (state, 1.0, 0.0, 0.0))


def _fading(window: int, kinds: tuple[int, ...]) -> dict[tuple[int, int], Move]:
    """States 1 to ``window`` count down on these classes."""
    return {(s, kind): (s - 1, 1.0, 0.0, 0.0) for s in range(1, window + 1) for kind in kinds}


def insult(window: int = 2, factor: float = 1.25) -> Machine:
    """An insult within so many words after another one is strengthened."""
    moves = _fading(window, (OTHER, THREAT, TARGET, NEGATION, REPORT))
    moves |= {(s, INSULT): (window, factor if s else 1.0, 0.0, 0.0) for s in range(window + 1)}
    return Machine(window + 1, moves)


def threat(window: int = 4, alone: float = 0.25) -> Machine:
    """A threat counts in full behind a target. Before that it counts for little, but if the clause's first target comes
    within so many words, the last threat is made up to its full weight. The last state has met a target."""
    met = window + 1
    moves = _fading(window, (OTHER, INSULT, NEGATION, REPORT))
    moves |= {(s, THREAT): (window, alone, 0.0, 0.0) for s in range(met)}
    moves |= {(s, TARGET): (met, 1.0, 0.0, 1 / alone - 1 if s else 0.0) for s in range(met)}
    return Machine(window + 2, moves)


def target(window: int = 3, factor: float = 1.5) -> Machine:
    """An insult behind a target is strengthened, and so is the last one if the clause's first target comes within so
    many words. The last state has met a target."""
    met = window + 1
    moves = _fading(window, (OTHER, THREAT, NEGATION, REPORT))
    moves |= {(s, INSULT): (window, 1.0, 0.0, 0.0) for s in range(met)} | {(met, INSULT): (met, factor, 0.0, 0.0)}
    moves |= {(s, TARGET): (met, 1.0, factor - 1 if s else 0.0, 0.0) for s in range(met)}
    return Machine(window + 2, moves)


def negation(window: int = 3, factor: float = 0.5) -> Machine:
    """Harm within so many words after a negation is softened."""
    moves = _fading(window, (OTHER, TARGET, REPORT)) | {(s, NEGATION): (window, 1.0, 0.0, 0.0) for s in range(window + 1)}
    moves |= {(s, kind): (s - 1, factor, 0.0, 0.0) for s in range(1, window + 1) for kind in (INSULT, THREAT)}
    return Machine(window + 1, moves)


def reported(factor: float = 0.5) -> Machine:
    """Harm behind a verb of speech in the same clause is softened."""
    return Machine(2, {(0, REPORT): (1, 1.0, 0.0, 0.0)} | {(1, kind): (1, factor, 0.0, 0.0) for kind in (INSULT, THREAT)})


def compose(*machines: Machine) -> Machine:
    """One machine that does what all do side by side; its states are the reachable tuples of theirs, numbered."""
    number, moves, ahead = {(0,) * len(machines): 0}, {}, [(0,) * len(machines)]
    while ahead:
        state = ahead.pop()
        for kind in CLASSES:
            steps = [m.step(s, kind) for m, s in zip(machines, state, strict=True)]
            after = tuple(s[0] for s in steps)
            if after not in number:
                number[after] = len(number)
                ahead.append(after)
            moves[number[state], kind] = (number[after], prod(s[1] for s in steps), sum(s[2] for s in steps), sum(s[3] for s in steps))
    return Machine(len(number), moves)


class Grammar:
    """The composed machine over a lexicon of weighted words and word beginnings, and the given threats."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words, self.stems = words, stems
        self.kinds = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(THREATS, THREAT)
        self.machine = compose(insult(), threat(), target(), negation(), reported())
        self.finder = ahocorasick.Automaton()
        for entry in {*words, *stems, *THREATS}:
            self.finder.add_word(entry, len(entry))
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        """The weight of a word as an insult."""
        found = self.words.get(word, 0.0)
        for n in STEMS:
            found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def clause(self, words: list[str]) -> float:
        """The score along the clause's path."""
        state, total, last = 0, 0.0, {INSULT: 0.0, THREAT: 0.0}
        for word in words:
            kind = self.kinds.get(word, OTHER)
            weight = self.weight(word)
            if weight and kind != THREAT:
                kind = INSULT
            elif kind == THREAT:
                weight = max(weight, THREAT_WEIGHT)
            state, factor, insults, threats = self.machine.moves[state, kind]
            total += insults * last[INSULT] + threats * last[THREAT]
            if kind in last:
                last[kind] = weight * factor
                total += last[kind]
        return total

    def clauses(self, text: str) -> tuple[list[float], int]:
        """The scores of the clauses that match, and how many clauses there are. Texts in which no word begins with an entry are not read further."""
        low = text.lower()
        if not any(end - n + 1 == 0 or not low[end - n].isalnum() for end, n in self.finder.iter(low)):
            return [], 0
        parts = CLAUSE.split(low)
        scores = [self.clause(WORD.findall(part)) for part in parts]
        return [s for s in scores if s], len(parts)


FEATURES = ("most", "second", "sum", "count", "share")


def features(scores: list[float], clauses: int) -> tuple[float, ...]:
    """The strongest and the second strongest clause, their sum and number on log scales, and the root of their share."""
    first, second, *_ = [*sorted(scores, reverse=True), 0.0, 0.0]
    return first, second, float(np.log1p(sum(scores))), float(np.log1p(len(scores))), (len(scores) / max(1, clauses)) ** 0.5


def learn_lexicon(sample: DataFrame, text_col: str, *, least_documents: int = 3, least_g: float = 18.0, sure_g: float = 50.0) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings of toxic documents, with log-odds as weights.

    From the most significant on (by the G statistic) those stay that are beyond doubt, or that remain significant by the
    documents in which fewer than three reliable ones before them occur. What goes to the driver are significant words
    of the bounded sample only."""
    # one row for each group of near copies: they share the least hash of their three-word shingles
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}']+"), lambda w: w != "")
    rows = sample.select(F.col("_label").cast("int").alias("toxic"), words.alias("words"))
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda n: F.xxhash64(F.array_join(F.slice("words", n, 3), " "))))
    rows = rows.withColumn("least", least)
    rows = rows.groupBy("toxic", "least").agg(F.max("words").alias("words"))
    # marked strings, 0 for a word and 1 for a beginning: arrays of structs have no hashed array_distinct
    grams = F.array_distinct(F.flatten(F.array(F.transform("words", lambda w: F.concat(F.lit("0"), w)), *(_beginnings(n) for n in STEMS))))
    total = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, n = total.get(1, 0), total.get(0, 0)
    if not p or not n:
        return {}, {}
    toxic = F.col("toxic") == 1
    counts = (
        rows.select("toxic", "least", F.explode(grams).alias("g"))
        .groupBy(F.substring("g", 1, 1).cast("int").alias("stem"), F.expr("substring(g, 2)").alias("gram"))
        .agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"), F.collect_list(F.when(toxic, F.col("least"))).alias("found"))
    )
    a, b = F.col("a"), F.col("b")
    expected = (a + b) * (p / (p + n))
    g = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / ((a + b) - expected))).otherwise(0.0))
    weight = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n + 1))
    kept = counts.where((a >= least_documents) & (weight > float(np.log(8)))).withColumns({"g": g, "weight": weight}).where(F.col("g") >= least_g)
    entries: tuple[dict[str, float], dict[str, float]] = {}, {}
    explained: Counter[int] = Counter()
    for r in kept.orderBy(F.desc("g"), F.desc("stem"), "gram").collect():
        new = sum(explained[document] < 3 for document in r.found)
        if r.g >= sure_g or r.g * new >= least_g * r.a:
            entries[r.stem][r.gram] = r.weight
            if r.a >= 4 * r.b:
                explained.update(r.found)
    return entries


def _beginnings(n: int) -> Column:
    longer = F.filter("words", lambda w: F.char_length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.lit("1"), F.substring(w, 1, n)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic weights (intercept first) by Newton steps."""
    z = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _with_features(df: DataFrame, text_col: str, words: dict[str, float], stems: dict[str, float]) -> DataFrame:
    small_batches(df.sparkSession)
    kept = df.schema.fields
    rows = df.select(*(F.col(f"`{f.name}`") for f in kept), text_or_empty(text_col).alias("_clause_text"))
    names = [f"_clause_{f}" for f in FEATURES]
    schema = StructType([*kept, *(StructField(n, DoubleType()) for n in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words, stems)
        for batch in batches:
            made = np.array([features(*grammar.clauses(t)) for t in batch.column(len(kept)).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c) for c in made.T)], names=[*(f.name for f in kept), *names])

    return rows.mapInArrow(work, schema)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 4,
    held_out: int = 2,
    most_labelled: int = 10_000,
    out: str = "score",
) -> DataFrame:
    """Adds the score: how likely the label is 1. Lexicon and weights are learned from at most ``most_labelled``
    documents, none of the held-out fold (``crc32(id) mod modulus = held_out``)."""
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, modulus=modulus, held_out=held_out, most=most_labelled)
    sample = materialize(sample, "labelled")
    words, stems = learn_lexicon(sample, text_col)
    if words or stems:
        rows = _with_features(sample.select(F.col("_label").cast("double"), text_col), text_col, words, stems).drop(text_col).toArrow()
        table = np.column_stack([c.to_numpy() for c in rows.columns])
        table = table[np.lexsort(table.T)]  # the order of the rows must not matter
        weights = _fit(table[:, 1:], (table[:, 0] > 0).astype(float))
    else:
        weights = np.array([-3.0, 1.0, 0.0, 1.0, 0.0, 0.0])
    total = F.lit(float(weights[0])) + sum(float(w) * F.col(f"_clause_{c}") for w, c in zip(weights[1:], FEATURES, strict=True))
    scored = _with_features(as_row(docs), f"row.`{text_col}`", words, stems)
    return scored.select(*row_columns(docs, out), (1 / (1 + F.exp(-total))).alias(out))
