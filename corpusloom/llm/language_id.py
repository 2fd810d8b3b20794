"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from every document that may be learned from.  The weights are trained on a
bounded sample by follow-the-regularised-leader with an elastic net (the L1 part keeps them sparse), and
a temperature fitted on a part that training did not see calibrates the probabilities.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, documents, shuffle_key, ship, unit

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: n-grams of 1 to 3 code points of the lowered text, hashed to 2**BITS features.
BITS = 16
#: Bound of the fit: documents a language, drawn by hash; windows of each (lengths in code points) besides the whole.
SAMPLE = 500
WINDOWS = (60, 150, 400)
EPOCHS = 3
#: FTRL-proximal: learning rate alpha / (beta + sqrt(sum of squares)), elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
#: Of five drawn documents one is for the temperature.
PART = 5


def features(text: str):
    """(ids, counts) of a text's hashed n-grams, ids ascending; the whole text, whatever its length."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    shift = np.uint32(32 - BITS)
    one = c * np.uint32(0x9E3779B1)
    grams = [one >> shift]
    if len(c) > 1:
        two = (one[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        grams.append(two >> shift)
        if len(c) > 2:
            grams.append(((two[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)) >> shift)
    ids = np.sort(np.concatenate(grams).astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[first].astype(np.int64), np.diff(np.concatenate([first, [len(ids)]]))


def weighted(idf, text: str):
    """The text's unit TF-IDF vector, with logarithmic term frequencies, as (ids, values)."""
    import numpy as np

    ids, counts = features(text)
    x = (1 + np.log(counts)) * idf[ids]
    norm = math.sqrt(float(x @ x))
    return ids, x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: object  # float64, a value a feature
    weights: object  # float64, features x languages, mostly zeros
    bias: object
    temperature: float = 1.0

    def logits(self, text: str):
        ids, x = weighted(self.idf, text)
        return x @ self.weights[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its probability; ``und`` and 0 for texts without a letter."""
        import numpy as np

        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def inverse_frequencies(docs: DataFrame):
    """idf of every feature over all of ``docs`` (text): log((1 + n) / (1 + df)) + 1, as an array."""
    import numpy as np

    schema = "feature int, df long"

    def count(batches):
        import pyarrow as pa

        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    df[features(text)[0]] += 1
                n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n))], names=["feature", "df"])

    # A row a feature, 2**BITS at most.
    found = docs.select("text").mapInArrow(count, schema).groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = {r.feature: r.df for r in found}
    n = df.pop(-1, 0)
    idf = np.full(1 << BITS, math.log(1 + n) + 1)
    for feature, k in df.items():
        idf[feature] = math.log((1 + n) / (1 + k)) + 1
    return idf


def sampled(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of about SAMPLE documents a language, the same in every run."""
    learn = docs.select("doc_id", "lang", F.length("text").alias("n"))
    sizes = learn.filter("n > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    drawn = docs.filter(F.length("text") > 0).join(F.broadcast(sizes), "lang")
    drawn = drawn.filter(unit(shuffle_key(F.col("doc_id"), "language")) < F.lit(float(SAMPLE)) / F.col("_rows"))
    rows = [(r.lang, r.text, r.key) for r in drawn.select("lang", "text", shuffle_key(F.col("doc_id"), "order").alias("key")).collect()]
    return [(lang, text) for lang, text, _ in sorted(rows, key=lambda r: (r[2], r[1])) if LETTER.search(text)]


def train(model: Model, rows: list[tuple[int, object, object]]) -> None:
    """FTRL-proximal over (language number, ids, values), one row at a time."""
    import numpy as np

    shape = (len(model.idf) + 1, len(model.languages))  # the last feature is the constant
    z, n = np.zeros(shape), np.zeros(shape)
    last = np.array([len(model.idf)])

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, ids, x in rows:
            ids, x = np.concatenate([ids, last]), np.concatenate([x, [1.0]])
            zs, ns = z[ids], n[ids]
            w = weights(zs, ns)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            grown = ns + g * g
            z[ids] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[ids] = grown
    w = weights(z, n)
    model.weights, model.bias = w[:-1], w[-1]


def fit_temperature(model: Model, rows: list[tuple[int, str]]) -> None:
    """The temperature with the least log loss over (language number, text), by golden-section search on its logarithm."""
    import numpy as np

    if not rows:
        return
    logits, y = np.array([model.logits(t) for _, t in rows]), np.array([k for k, _ in rows])

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(y)), y]).mean())

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = math.exp((low + high) / 2)


def windows(text: str) -> list[str]:
    """The whole text and evenly placed parts of some lengths: short texts look different from long ones."""
    out = [text]
    for i, size in enumerate(WINDOWS):
        if len(text) > 2 * size:
            at = (i + 1) * (len(text) - size) // (len(WINDOWS) + 1)
            out.append(text[at : at + size])
    return out


def fit(docs: DataFrame) -> Model:
    """The model of the documents with a language that are not held out; reads doc_id, text and lang."""
    import numpy as np

    ship(docs.sparkSession)
    learn = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = sampled(learn)
    languages = sorted({lang for lang, _ in rows})
    model = Model(languages, inverse_frequencies(learn), np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)))
    if not rows:
        return model
    number = {lang: i for i, lang in enumerate(languages)}
    seen = [r for i, r in enumerate(rows) if i % PART] or rows
    train(model, [(number[lang], *weighted(model.idf, part)) for lang, text in seen for part in windows(text)])
    fit_temperature(model, [(number[lang], part) for lang, text in rows[::PART] for part in windows(text)])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text: a map, no shuffle.

    Reads doc_id and text.  A null text or one without a letter is ``und`` with score 0, as is any text if
    nothing could be learned.  Repeated rows give repeated rows, an empty table an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS x languages
    schema = "doc_id long, lang_pred string, score double"

    def work(doc_ids, texts):
        found = [sent.value.predict(t) for t in texts]
        return doc_ids, [lang for lang, _ in found], [p for _, p in found]

    predicted = docs.select("doc_id", "text").mapInArrow(arrow_batches(work, schema), schema)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
