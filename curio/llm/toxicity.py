"""Operator 10, toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads a word and writes its class (insult, threat, target,
negation, reported speech, other) and, for insults, a weight. Three small
transducers are composed with it into one deterministic table: negation marks
insults within three words of a negation, reported speech marks those after a verb
of saying up to the clause's end, and the target machine marks insults and threats
that stand within four words of an address. Marks scale a match's weight, and a
clause scores the sum of its matches; a logistic curve over the strongest clause and
the total gives the score. Words alone are never summed over a text without passing
the grammar.

Insult arcs are learned from labelled training texts: whole words and stems
(prefixes of 4 to 7 letters that at least three words share) that stand almost only
in toxic texts, weighted by log odds. The fit uses at most ``SAMPLE_ROWS`` labelled
rows (smallest hash of the id) and keeps at most ``MAX_ARCS`` arcs, those with the
most toxic texts; both are documented bounds of the model. Other word lists are fixed.
Scores read nothing but the text, and the whole of it.

Defined results: null and empty texts have no match and get the curve's lowest score.
Repeated rows score alike; a null id is never held out and never labelled. Without
training labels there are no insult arcs and the fixed lists decide. An empty table
gives an empty table; other columns of the tables aren't read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import ship, sliced, texts_of
from curio.session import discard, materialize

ship(__name__)

SAMPLE_ROWS, MAX_ARCS = 40_000, 50_000
STEMS = range(4, 8)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

# Word lists of the grammar (English, German, French, Spanish).
FIXED = {
    THREAT: "kill hurt destroy beat stab shoot murder töten umbringen schlagen tuer frapper detruire matar golpear destruir",
    TARGET: "you your you're u they them he she du dich dir ihr euch sie tu te toi vous ils elle usted ustedes ti ellos",
    NEGATION: "not no never isn't aren't don't neither nor nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni ningún",
    REPORT: "said says say called calls wrote writes claimed quoted reported sagte sagt nannte schrieb dit disait appelé écrit "
            "dijo dice llamó escribió",
}
EDGE = ".,;:!?\"'()[]{}<>«»„“”*-_…¡¿"
STOPS = ".;!?…"
NEGATED, REPORTED, TARGETED, THREATENED = 0.2, 0.4, 1.5, 3.0


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, symbols out)``, tabled."""

    def __init__(self, start, step):
        self.start, self.step, self.table = start, step, {}

    def __call__(self, state, symbol):
        key = (state, symbol)
        got = self.table.get(key)
        if got is None:
            got = self.table[key] = self.step(state, symbol)
        return got

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other reads what this one writes."""
        def step(state, symbol):
            first, second = state
            first, mid = self(first, symbol)
            second, out = other(second, mid)
            return (first, second), out
        return Transducer((self.start, other.start), step)


# Symbols between the machines: (class, mark weight).
def _negation(left, symbol):
    kind, weight = symbol
    if kind == END:
        return 0, symbol
    if kind == NEGATION:
        return 3, symbol
    if left and kind in (INSULT, THREAT):
        symbol = (kind, weight * NEGATED)
    return max(0, left - 1), symbol


def _report(inside, symbol):
    kind, weight = symbol
    if kind == END:
        return 0, symbol
    if inside and kind in (INSULT, THREAT):
        symbol = (kind, weight * REPORTED)
    return inside or int(kind == REPORT), symbol


def _target(state, symbol):
    """State: words since an address (0: none near, 4 at most), the weight of a
    threat that waits for one."""
    since, threat = state
    kind, weight = symbol
    if kind == END:
        return (0, 0.0), (END, 0.0)
    after = 0 if since in (0, 4) else since + 1
    if kind == TARGET:
        return (1, 0.0), (THREAT, threat * THREATENED) if threat else (OTHER, 0.0)
    if kind == THREAT:
        return (after, weight), (THREAT, weight * THREATENED) if since else (OTHER, 0.0)
    if kind == INSULT:
        return (after, threat), (INSULT, weight * TARGETED if since else weight)
    return (after, threat), (OTHER, 0.0)


def grammar() -> Transducer:
    return Transducer(0, _negation).then(Transducer(0, _report)).then(Transducer((0, 0.0), _target))


class Lexicon(dict):
    """Memo word -> (class, insult weight, ends a clause); bounded."""

    limit = 400_000

    def __init__(self, arcs: dict[str, float]):
        super().__init__()
        self.arcs = arcs
        self.fixed = {w: kind for kind, words in FIXED.items() for w in words.split()}

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        plain = word.strip(EDGE).lower()
        weight = self.arcs.get(plain)
        if weight is None:
            weight = max((self.arcs.get(plain[:n] + "*", 0.0) for n in STEMS if n < len(plain)), default=0.0)
        kind = self.fixed.get(plain, OTHER) if not weight else INSULT
        got = self[word] = (kind, weight, word[-1] in STOPS)
        return got


def clause_scores(text: str, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """Weights of the clauses that hold a match."""
    if not any(x[0] in (INSULT, THREAT) for x in map(lexicon.__getitem__, text.split())):
        return []
    out = []
    for line in text.split("\n"):
        state, score = machine.start, 0.0
        for kind, weight, ends in [*map(lexicon.__getitem__, line.split()), (END, 0.0, False)]:
            state, (what, factor) = machine(state, (kind, 1.0 if kind in (INSULT, THREAT) else 0.0))
            if what == INSULT:
                score += factor * weight
            elif what == THREAT:
                score += factor
            if ends or kind == END:
                if score:
                    out.append(score)
                score, (state, _) = 0.0, machine(state, (END, 0.0))
    return out


def _summary(scores: list[float]) -> tuple[float, float]:
    return max(scores, default=0.0), float(np.log1p(sum(scores)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features_of(text: str) -> set[str]:
    words = {w.strip(EDGE).lower() for w in text.split()}
    words.discard("")
    return words


def learn_arcs(train: DataFrame, max_arcs: int = MAX_ARCS) -> dict[str, float]:
    """Insult arcs from ``(text, toxic)`` rows: counts of texts for each word are
    summed per task first, then by Spark; stems are summed from words' counts."""
    def run(batches):
        for batch in sliced(batches, rows=4096):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for w in _features_of(text):
                    counts.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], names=["arc", "clean", "toxic"])

    total = train.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not total[1]:
        return {}
    words = train.select("text", "toxic").mapInArrow(run, "arc string, clean long, toxic long").groupBy("arc").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    stems = words.select(F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda n: F.when(
        F.length("arc") > n, F.concat(F.substring(F.col("arc"), F.lit(1), n), F.lit("*"))))).alias("arc"), "clean", "toxic").where(
        "arc is not null").groupBy("arc").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"),
                                             F.count_if(F.col("toxic") > 0).alias("words")).where("words >= 3").drop("words")
    # at least 3 toxic texts, and rates that make toxic texts the most
    rate = (F.col("toxic") + 0.5) / (total[1] + 1) / ((F.col("clean") + 0.5) / (total[0] + 1))
    pure = F.col("toxic") >= 0.9 * (F.col("clean") + F.col("toxic"))
    rows = words.withColumn("stem", F.lit(0)).unionByName(stems.withColumn("stem", F.lit(1))).withColumn("weight", F.log(rate)).where(
        pure & (F.col("toxic") >= F.when(F.col("stem") == 1, 8).otherwise(3)) & (F.col("weight") > 2)).orderBy(
        F.desc("toxic"), "arc").limit(max_arcs).collect()
    return {r.arc: float(r.weight) for r in rows}


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; slopes are kept at 0 or more,
    so that a stronger match never lowers a score."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w[1:] = np.maximum(w[1:], 0.0)
    return w


class Model:
    def __init__(self, arcs: dict[str, float], curve: np.ndarray):
        self.arcs, self.curve = arcs, curve


def clause_table(docs: DataFrame, model_arcs: dict[str, float], extra: list[str]) -> DataFrame:
    """``extra`` columns and the two figures of every text; the arcs, bounded by
    ``MAX_ARCS``, are broadcast."""
    arcs = docs.sparkSession.sparkContext.broadcast(model_arcs)
    frame = docs.select(*extra, F.col("text").cast("string").alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]] + ["best double", "total double"])

    def run(batches):
        lexicon, machine = Lexicon(arcs.value), grammar()
        for batch in sliced(batches):
            both = [_summary(clause_scores(t, lexicon, machine)) for t in texts_of(batch.column(len(extra)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(extra))] + [pa.array([b[k] for b in both], pa.float64()) for k in (0, 1)],
                names=[*extra, "best", "total"])

    return frame.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on training rows of ``labels`` (doc_id, toxic) only. The curve is fitted
    on figures from arcs of the other half of the sample, so arcs that only fit
    their own texts count for little."""
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows)
    train = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-train")
    figures = []
    for half in (0, 1):
        arcs = learn_arcs(train.where(F.pmod("h", F.lit(2)) == half))
        rows = clause_table(train.where(F.pmod("h", F.lit(2)) != half), arcs, ["toxic"]).groupBy("toxic", "best", "total").count()
        figures += rows.limit(sample_rows).collect()
    arcs = learn_arcs(train)
    discard(train)
    if not figures or not arcs:
        return Model(arcs, np.array([-3.0, 0.5, 0.5]))
    data = np.array([[r["best"], r["total"], r["toxic"], r["count"]] for r in figures])
    data = np.repeat(data, data[:, 3].astype(int), axis=0)
    return Model(arcs, _fit(data[:, :2], data[:, 2]))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``."""
    w = [float(x) for x in model.curve]
    z = F.lit(w[0]) + F.lit(w[1]) * F.col("best") + F.lit(w[2]) * F.col("total")
    return clause_table(docs, model.arcs, keep).select(*keep, (1 / (1 + F.exp(-z))).alias("score"))
