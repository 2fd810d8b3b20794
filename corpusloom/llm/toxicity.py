"""Toxicity by maximum-scoring segments over token log-odds.

Fitting: in a bounded sample of labelled documents, count in how many toxic and clean ones each token
occurs (a word, and its beginnings of a few letters, for words that were never seen); the log-odds
ratio under a Dirichlet prior in proportion to the token's overall share, over its standard error, says
which tokens tell the classes apart.  Scoring: those tokens weigh their log-odds, every token costs a
little, and one linear scan finds all maximal segments.  A segment's score S becomes lambda*S - ln(K*n) by the
extreme-value law of segment scores in clean texts of n tokens: above 0, chance would bring less than one
such passage in a text of this length.  A logistic curve over the passages' excess gives the probability.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, documents, shuffle_key, ship, staged, unit, unused

TOKEN = re.compile(r"\w+")
#: Lengths of the word beginnings that count as tokens too.
STEMS = (4, 5, 6, 7, 8)
#: Bounds of the fit: labelled documents a class (drawn by hash).  The telling tokens of so many documents do not grow with
#: the corpus; a fit that finds more of them than this raises, as the model is broadcast.
SAMPLE_TOXIC = 10_000
SAMPLE_CLEAN = 15_000
MOST_TOKENS = 500_000
#: Pseudo-counts of the prior as a whole and at least for each token, documents that a token has to occur in, and
#: standard errors that make it count.
PRIOR = 50.0
LEAST_PRIOR = 0.5
LEAST_DOCS = 5
LEAST_Z = 3.0
#: What each token costs: makes the mean score of clean text negative, as the segment law needs.
DRIFT = 0.02
#: Words whose weights a worker keeps; when full, the store starts anew.
KEPT_WORDS = 200_000
#: Tokens that a worker counts before it passes its counts on.
COUNTED_AT_ONCE = 100_000


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # token -> (log-odds, z)
    scale: float = 1.0  # lambda
    size: float = 1.0  # K
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)  # logistic: constant, best passage, sum of passages


def tokens_of(word: str) -> list[str]:
    """The tokens a word stands for: itself, and its beginnings, marked by their star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def weight_of(weights: dict[str, tuple[float, float]], word: str) -> float:
    """The log-odds of the word's most telling token; 0 if none is known."""
    found = [w for t in tokens_of(word) if (w := weights.get(t))]
    return max(found, key=lambda w: abs(w[1]))[0] if found else 0.0


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place) of a sequence.

    ``hits`` are the places with a weight, in order; every place costs ``drift``.  The linear scan keeps
    candidates with the sums before and after them and merges a new one into the last candidate that
    starts lower, for as long as it ends higher.  Segments without a hit cannot score above 0.
    """
    done: list[list] = []  # [sum before, sum after, first, last]
    weights = 0.0
    for place, weight in hits:
        before = weights - drift * place
        weights += weight
        if weight <= drift:
            continue
        new = [before, before + weight - drift, place, place]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][0] >= new[0]:
                j -= 1
            if j < 0 or done[j][1] >= new[1]:
                done.append(new)
                break
            new = [done[j][0], new[1], done[j][2], new[3]]
            del done[j:]
    return [(after - before, first, last) for before, after, first, last in done]


def hits_of(text: str, weigh) -> tuple[int, list[tuple[int, float]]]:
    """The number of words and the places with a weight; ``weigh`` maps a list of words to weights."""
    words = TOKEN.findall(text.lower())
    return len(words), [(i, w) for i, w in enumerate(weigh(words)) if w]


class Weigher:
    """Weights of words, remembered."""

    def __init__(self, weights):
        self.weights, self.known = weights, {}

    def __call__(self, words):
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = weight_of(self.weights, w)
        return [known[w] for w in words]


def evidence(model: Model, n: int, scores: list[float]) -> tuple[float, float]:
    """The best passage's excess over chance (negative if it is below), and the root of the sum of all above."""
    chance = math.log(model.size * max(n, 1))
    best = model.scale * max(scores, default=0.0) - chance
    total = sum(max(0.0, model.scale * s - chance) for s in scores)
    return best, math.sqrt(total)


def probability(model: Model, n: int, scores: list[float]) -> float:
    best, total = evidence(model, n, scores)
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * best + c * total))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents that are not held out, at most about the bounds a class.

    A document is drawn if its hash lies below bound / rows of its class, so that every run draws the same.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / max(1, sizes.get(1, 0))).otherwise(SAMPLE_CLEAN / max(1, sizes.get(0, 0)))
    drawn = known.filter(unit(shuffle_key(F.col("doc_id"), "toxicity")) < rate)
    # Bounded by the two constants, whatever the labels' number.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return staged(joined, "toxicity-sample")


def token_weights(sample: DataFrame) -> dict[str, tuple[float, float]]:
    """Log-odds and z of all telling tokens."""
    schema = "token string, y1 long, y0 long, d1 long, d0 long"

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        seen: dict[str, list[int]] = {}

        def flushed():
            columns = [pa.array(seen.keys(), pa.string()), *[pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4)]]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["token", "y1", "y0", "d1", "d0"])

        for b in batches:
            for i in range(b.num_rows):
                clean = 1 - b.column(1)[i].as_py()
                own: dict[str, int] = {}
                for w, k in Counter(TOKEN.findall(b.column(0)[i].as_py().lower())).items():
                    for t in tokens_of(w):
                        own[t] = own.get(t, 0) + k
                for t, k in own.items():
                    c = seen.get(t) or seen.setdefault(t, [0, 0, 0, 0])
                    c[clean] += k
                    c[2 + clean] += 1
                if len(seen) > COUNTED_AT_ONCE:
                    yield flushed()
        if seen:
            yield flushed()

    counts = sample.select("text", "toxic").mapInArrow(count, schema).groupBy("token").agg(*[F.sum(c).alias(c) for c in ("y1", "y0", "d1", "d0")])
    counts = staged(counts, "toxicity-tokens")
    sums = [float(v or 0) for v in counts.agg(*[F.sum(c) for c in ("y1", "y0", "d1", "d0")]).head()]

    def log_odds(one: str, zero: str, n1: float, n0: float) -> tuple[Column, Column]:
        prior = PRIOR * (F.col(one) + F.col(zero)) / F.lit(max(1.0, n1 + n0)) + LEAST_PRIOR
        a1, a0 = F.col(one) + prior, F.col(zero) + prior
        odds = F.log(a1 / (n1 + PRIOR - a1)) - F.log(a0 / (n0 + PRIOR - a0))
        return odds, odds / F.sqrt(1 / a1 + 1 / a0)

    # Occurrences give the weight; documents, in which a burst counts once, say whether to trust it.
    odds, _ = log_odds("y1", "y0", sums[0], sums[1])
    _, z = log_odds("d1", "d0", sums[2], sums[3])
    telling = counts.filter(F.col("d1") + F.col("d0") >= LEAST_DOCS).select("token", odds.alias("odds"), z.alias("z"))
    telling = telling.filter(F.abs("z") >= LEAST_Z).limit(MOST_TOKENS + 1).collect()
    if len(telling) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} telling tokens: the model would be too large to broadcast")
    return {r.token: (r.odds, r.z) for r in sorted(telling)}


def fit_chance(model: Model, found: list[tuple[float, int]], bests: list[tuple[int, float]]) -> None:
    """lambda and K of the segment law from clean texts: how often each weight occurs, and each text's words and best score.

    lambda is the positive root of mean(exp(lambda * score)) = 1 over all tokens; given it, n * exp(-lambda * best) is
    exponential with rate K, whose estimate is one over its mean.
    """
    words, hits = sum(n for n, _ in bests), sum(k for _, k in found)
    if not words or not any(w > DRIFT for w, _ in found):
        return

    def excess(x: float) -> float:
        hit = sum(k * math.exp(min(700.0, x * (w - DRIFT))) for w, k in found)
        return (hit + (words - hits) * math.exp(-x * DRIFT)) / words - 1

    low, high = 1e-3, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, 2 * high
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.scale = max(high, 0.05)
    law = [n * math.exp(-model.scale * best) for n, best in bests if n]
    model.size = len(law) / sum(law) if law else 1.0


def fit_curve(model: Model, rows: list[tuple[int, float, float]]) -> None:
    """The logistic curve over (toxic, best passage, sum of passages), by Newton steps with a small ridge."""
    import numpy as np

    x = np.array([[1.0, best, total] for _, best, total in rows])
    y = np.array([float(t) for t, _, _ in rows])
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.curve = tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of the labelled documents; without both classes, the share of toxic ones."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels)
    weights = token_weights(sample)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "toxic int, n long, found array<double>, scores array<double>"

    state: dict = {}  # of one task

    def work(texts, toxic):
        weigh = state.setdefault("weigher", Weigher(sent.value))
        out = [[], [], [], []]
        for text, t in zip(texts, toxic, strict=True):
            n, hits = hits_of(text, weigh)
            for column, v in zip(out, (t, n, [w for _, w in hits], [s[0] for s in maximal_segments(hits)]), strict=True):
                column.append(v)
        return out

    rows = staged(sample.select("text", "toxic").mapInArrow(arrow_batches(work, schema), schema), "toxicity-passages")
    # To the driver: three numbers a sampled document, and a row a weight of the model; sorted for the same sums in every run.
    bests = sorted(map(tuple, rows.select("toxic", "n", F.coalesce(F.array_max("scores"), F.lit(0.0))).collect()))
    model = Model(weights)
    if len({t for t, _, _ in bests}) < 2:
        share = (sum(t for t, _, _ in bests) + 0.5) / (len(bests) + 1)
        model.curve = (math.log(share / (1 - share)), 0.0, 0.0)
        return model
    found = rows.filter("toxic = 0").select(F.explode("found").alias("weight")).groupBy("weight").agg(F.count(F.lit(1)))
    fit_chance(model, sorted(map(tuple, found.collect())), [(n, best) for t, n, best in bests if not t])
    law = Model({}, model.scale, model.size)
    schema = "toxic int, best double, total double"

    def judge(toxic, n, scores):
        return toxic, *zip(*(evidence(law, *row) for row in zip(n, scores, strict=True)), strict=True)

    judged = rows.select("toxic", "n", "scores").mapInArrow(arrow_batches(judge, schema), schema)
    fit_curve(model, sorted(map(tuple, judged.collect())))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text: a map, no shuffle.

    Reads doc_id and text, the latter alone for the score.  A null text counts as empty; texts without
    words get the score of a text without passages.  Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = "doc_id long, score double"

    state: dict = {}  # of one task

    def work(doc_ids, texts):
        m = sent.value
        weigh = state.setdefault("weigher", Weigher(m.weights))
        out = []
        for text in texts:
            n, hits = hits_of(text or "", weigh)
            out.append(probability(m, n, [s[0] for s in maximal_segments(hits)]))
        return doc_ids, out

    scored = docs.select("doc_id", "text").mapInArrow(arrow_batches(work, schema), schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, start and end (code points of the lowered text), excess over chance."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = "doc_id long, start long, end long, excess double"

    state: dict = {}  # of one task

    def work(doc_ids, texts):
        m = sent.value
        weigh = state.setdefault("weigher", Weigher(m.weights))
        out = [[], [], [], []]
        for doc_id, text in zip(doc_ids, texts, strict=True):
            low = (text or "").lower()
            n, hits = hits_of(low, weigh)
            spans = [w.span() for w in TOKEN.finditer(low)] if hits else []
            chance = math.log(m.size * max(n, 1))
            for s, first, last in maximal_segments(hits):
                if m.scale * s > chance:
                    for column, v in zip(out, (doc_id, spans[first][0], spans[last][1], m.scale * s - chance), strict=True):
                        column.append(v)
        return out

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(work, schema), schema)


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of ``docs``, whatever their names; repeated rows stay repeated."""
    model = fit(docs, labels)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    mark = unused(docs, "_toxicity")
    marked = docs.withColumn(mark, text_score(sent)(F.coalesce("text", F.lit(""))))
    return marked.filter(F.col(mark) < 0.5).select(*docs.columns)


def text_score(sent):
    """A column function: the probability of a text under a broadcast model."""
    state: dict = {}  # of one task

    def work(texts: pd.Series) -> pd.Series:
        m = sent.value
        weigh = state.setdefault("weigher", Weigher(m.weights))
        out = []
        for text in texts:
            n, hits = hits_of(text, weigh)
            out.append(probability(m, n, [s[0] for s in maximal_segments(hits)]))
        return pd.Series(out, dtype=float)

    return F.pandas_udf(work, "double")  # the text is the only column that leaves the JVM


def query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
