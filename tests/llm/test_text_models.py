import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import language_id as li
from corpusloom.llm import order_minhash as om
from corpusloom.llm import secret_ledger as sl
from corpusloom.llm import toxicity as tx
from corpusloom.llm.common import documents
from tests.conftest import SF

MID = "/root/testdata/sf0.01"


def plain_sketch(text, sketcher):
    """The sketch from the definition: number the k-mers, take the two least of each order, in text order."""
    if not text:
        return [0] * sketcher.entries
    hashes, place = sketcher.kmers(text)
    seen = sorted(zip(place.tolist(), hashes.tolist(), strict=True))
    out = []
    for scale in sketcher.scale[:, 0].tolist():
        two = sorted(((h * scale) % 2**32, i, h) for i, h in seen)[:2]
        first, second = sorted((i, h) for _, i, h in (two * 2)[:2])
        pair = (first[1] * 0x9E3779B97F4A7C15 + second[1] * 0xC2B2AE3D27D4EB4F) % 2**64
        out.append(((pair ^ pair >> 29) * 0xBF58476D1CE4E5B9) % 2**64 >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abcabcabcabcabcabcabc", "The quick brown fox jumps over the lazy dog " * 3, "é😀" * 40])
def test_sketch_matches_its_definition(text):
    s = om.Sketcher()
    assert s.sketch(text).tolist() == plain_sketch(text, s)


def test_occurrences_and_order_count():
    s = om.Sketcher(entries=256)
    base = " ".join(f"w{i}" for i in range(200))
    words = base.split()
    turned = " ".join(words[100:] + words[:100])
    assert om.likeness(s.sketch(base), s.sketch(base)) == 1
    assert om.likeness(s.sketch(base), s.sketch(turned)) < 0.75  # a set of k-mers would see hardly any change
    assert om.likeness(s.sketch(base), s.sketch(base + " tail")) > 0.8
    assert om.likeness(s.sketch("ab" * 20), s.sketch("ab" * 200)) < 0.3
    long = "".join(random.Random(1).choices("abcdefgh ", k=30_000))
    assert om.likeness(s.sketch(long), s.sketch(long[:20_000])) > 0.2


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_fingerprint_pairs_follow_the_sequence(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or 0, r[2].encode()))
    s = om.Sketcher()
    sketch = {t: s.sketch(t) for t in {r[2] for r in rows}}
    want = Counter()
    for i, (_, d, t) in enumerate(rows):
        n = rows[i - 1][2]
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        se = s.sketch(e)
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), om.text_of(sketch[t]), om.text_of(se), om.likeness(sketch[t], se), om.likeness(sketch[t], sketch[n])] += 1
    assert Counter(tuple(r) for r in om.fingerprint_pairs(docs).collect()) == want
    assert om.fingerprint_pairs(docs.filter("doc_id = 3").limit(1)).head().near_next == 1


def test_edits_are_nearer_than_strangers(spark):
    rows = om.query(spark, SF).filter("n_chars >= 200").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.2 > 0.1 > np.mean([r.near_next for r in rows])
    assert np.mean([r.near_edited > r.near_next for r in rows if r.near_next < 1]) > 0.97


def best_segment(scores):
    return max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))


def plain_segments(scores, at=0):
    """All maximal segments: the best one, then those on either side of it."""
    if not scores or max(scores) <= 1e-12:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda b: (round(b[0], 9), b[1], b[2]))
    i, n = -best[2], -best[1]
    return plain_segments(scores[:i], at) + [(round(best[0], 6), at + i, at + i + n - 1)] + plain_segments(scores[i + n :], at + i + n)


def test_segments_are_all_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 25)
        hits = [(i, rng.choice([-1.37, 0.83, 2.219, 0.31])) for i in range(n) if rng.random() < 0.5]
        scores = [-0.25] * n
        for i, w in hits:
            scores[i] += w
        got = [(round(s, 6), a, b) for s, a, b in tx.maximal_segments(hits, 0.25)]
        assert sorted(got, key=lambda s: s[1]) == plain_segments(scores)


@pytest.fixture(scope="module")
def toxic_model(spark):
    return tx.fit(documents(spark, MID), spark.read.parquet(f"{MID}/labels.parquet"))


def test_toxicity_on_held_out_documents(spark, toxic_model):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = tx.score(documents(spark, MID), toxic_model).collect()
    assert len(rows) == documents(spark, MID).count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert sum(p and not y for p, y in held) <= 1


def test_toxicity_of_odd_rows_and_missing_labels(spark, odd, none, toxic_model):
    assert tx.score(odd, toxic_model).count() == odd.count() and tx.score(none, toxic_model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tx.fit(odd, nothing)
    assert {round(r.score, 6) for r in tx.score(odd, model).collect()} == {0.5}
    one_class = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in tx.score(odd, tx.fit(odd, one_class)).collect())
    assert sorted(map(str, tx.clean_documents(odd, one_class).collect())) == sorted(map(str, odd.collect()))
    assert tx.clean_documents(odd, one_class).columns == odd.columns and tx.clean_documents(odd, one_class).count() == odd.count()


def test_fit_matches_an_independent_version(spark):
    import math

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["vile", "grim"] * (i % 3 == 0) + [f"w{k}" for k in range(40)], k=rng.randint(20, 60)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    learned = [(t.lower().split(), i % 3 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    y, d = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for words, toxic in learned:
        own = Counter(t for w in words for t in [w, *(w[:k] + "*" for k in tx.STEMS if len(w) >= k)])
        y[toxic].update(own)
        d[toxic].update(own.keys())

    def odds(one, zero, token):
        n1, n0 = one.total(), zero.total()
        prior = tx.PRIOR * (one[token] + zero[token]) / (n1 + n0) + tx.LEAST_PRIOR
        a1, a0 = one[token] + prior, zero[token] + prior
        x = math.log(a1 / (n1 + tx.PRIOR - a1)) - math.log(a0 / (n0 + tx.PRIOR - a0))
        return x, x / math.sqrt(1 / a1 + 1 / a0)

    every = {t: (odds(y[True], y[False], t)[0], odds(d[True], d[False], t)[1]) for t in y[True] | y[False] if d[True][t] + d[False][t] >= tx.LEAST_DOCS}
    telling = {t: v for t, v in every.items() if abs(v[1]) >= tx.LEAST_Z}
    assert "vile" in model.weights and set(model.weights) == set(telling)
    assert all(model.weights[t] == pytest.approx(v) for t, v in telling.items())
    # K is one over the mean of n * exp(-lambda * best) over the clean texts that were learned from.
    law = []
    for words, toxic in learned:
        if not toxic:
            n, hits = tx.hits_of(" ".join(words), lambda ws: [tx.weight_of(telling, w) for w in ws])
            law.append(n * math.exp(-model.scale * max((s for s, _, _ in tx.maximal_segments(hits)), default=0.0)))
    if model.size != 1.0:
        assert model.size == pytest.approx(len(law) / sum(law))


def test_passages_name_their_place(spark, toxic_model):
    text = "the of and " * 30 + "idiot moron scum idiot " + "the of and " * 30
    docs = spark.createDataFrame([(1, text), (2, "the of and " * 60)], "doc_id long, text string")
    rows = tx.passages(docs, toxic_model).collect()
    assert {r.doc_id for r in rows} == {1}
    assert any("moron" in text[r.start : r.end] for r in rows)


@pytest.fixture(scope="module")
def language_model(spark):
    return li.fit(documents(spark, MID))


def test_languages_of_held_out_documents(spark, language_model):
    docs = documents(spark, MID)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = li.predict(docs, language_model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98
    assert 0.05 < (language_model.weights == 0).mean()


def test_undetermined_texts_and_no_training(spark, odd, none, language_model):
    rows = {r.doc_id: r for r in li.predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! _"), (4, "é")], "doc_id long, text string"), language_model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred in language_model.languages
    assert li.predict(odd, language_model).count() == odd.count() and li.predict(none, language_model).count() == 0
    assert {r.lang_pred for r in li.predict(odd, li.fit(none)).collect()} == {"und"}


def test_features_count_every_gram():
    ids, counts = li.features("abcab")
    assert counts.sum() == 5 + 4 + 3 and (np.diff(ids) > 0).all()
    assert li.features("x")[1].sum() == 1


def plain_spans(t):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


@pytest.mark.parametrize("which", ["odd", "sf", "cases"])
def test_scans_match_brute_force(spark, odd, tmp_path, which):
    cases = ["token: token: abcdef", "ſecret=abcdefgh", "toKen=abcdefgh", "API-KEY=abcdefgh api_key='abcdef' Apikey = \"a.b/c+d\"", "x" + "deadbeef" * 4 + "g" + "0" * 23, "AKIAAKIA" + "B" * 16, "password=short", "secret:\n abcdefgh", "é" * 5 + "passwd:abcdef"]
    docs = {"odd": odd, "sf": documents(spark, SF), "cases": spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")}[which]
    want = Counter()
    for r in docs.collect():
        s = plain_spans(r.text or "")
        k = Counter(x[2] for x in s)
        want[r.doc_id, k["assign"], k["access"], k["hex"], hashlib.sha256(",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in s).encode()).hexdigest()] += 1
    rows = sl.scan(docs, sl.BlobLedger(spark, str(tmp_path / "l"))).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows) == want


def test_only_unseen_pairs_are_scanned(spark, tmp_path, none):
    ledger = sl.BlobLedger(spark, str(tmp_path / "l"))
    one = spark.createDataFrame([(1, "token=abcdefg"), (2, "token=abcdefg"), (3, "x")], "doc_id long, text string")
    assert sl.scan(one, ledger).count() == 3 and ledger.findings("1").count() == 2
    two = spark.createDataFrame([(4, "token=abcdefg"), (5, "new")], "doc_id long, text string")
    assert {r.doc_id: r.n_assign for r in sl.scan(two, ledger).collect()} == {4: 1, 5: 0}
    assert ledger.findings("1").count() == 3
    assert sl.scan(two, ledger, "2").count() == 2 and ledger.findings("2").count() == 2
    assert sl.scan(none, ledger).count() == 0


def test_further_kinds_add_spans():
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36
    assert sl.scan_text(text)[4] == "pem:0:31,forge:32:72,hex:36:72"


def test_web_tokens_are_those_of_the_pattern_in_linear_time():
    import time

    pattern = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(["eyJ", "a", "bcdefgh", "12345678", ".", ".", " ", "-_", "é"], k=rng.randint(1, 30)))
        assert sl.web_spans(text) == [m.span() for m in pattern.finditer(text)]
    began = time.time()
    assert sl.web_spans("eyJ" * 1_000_000) == [] and sl.web_spans("eyJeyJeyJeyJ." * 100_000)
    assert time.time() - began < 5


def test_blobs_recorded_twice_are_reported_once(spark, tmp_path):
    ledger = sl.BlobLedger(spark, str(tmp_path / "l"))
    docs = spark.createDataFrame([(1, "token=abcdefg"), (2, "x")], "doc_id long, text string")
    assert sl.scan(docs, ledger).count() == 2
    ledger.append(ledger.recorded("1"))
    assert sl.scan(docs, ledger).count() == 2 and ledger.findings("1").count() == 2
