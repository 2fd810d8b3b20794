import random
import re

import numpy as np
import pytest

from corpusloom.llm import jaccard
from corpusloom.llm import simhash as sh
from corpusloom.llm.common import documents
from tests.conftest import SF


def plain_set(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset([" ".join(w)] if 0 < len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)])


def plain_kept(rows, threshold=0.8):
    """Every pair of distinct sets is compared."""
    first = {}
    for d, t in rows:
        first.setdefault(plain_set(t), []).append(d)
    sets = list(first)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and (k := len(a & b)) >= threshold * (len(a) + len(b) - k) - 1e-9 and root(i) != root(j):
                up[root(i)] = root(j)
    least = {}
    for i, s in enumerate(sets):
        least[root(i)] = min([d for d in first[s] if d is not None] + [least.get(root(i), float("inf"))])
    gone = {d for i, s in enumerate(sets) for d in first[s] if d is not None and d != least[root(i)]}
    return sorted(str(d) for d, _ in rows if d not in gone)


def planted():
    """Dense groups of copies with some words changed, chains, pairs at and next to 0.8, and a passage that all share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for size in (3, 40, 150):
        base = [word() for _ in range(200)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(0, 6)):
                copy[at] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for _ in range(25):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    for n in (34, 44, 54, 94):  # n - 4 shingles; the last words changed
        base = [word() for _ in range(n)]
        texts += [" ".join(base)] + [" ".join(base[: n - k] + [word() for _ in range(k)]) for k in range(1, n // 6)]
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(80)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("which", ["odd", "sf", "planted"])
@pytest.mark.parametrize("pivots", [(2, 16, 128), (1,), ()])
def test_near_copies_match_brute_force(spark, odd, which, pivots, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    if which == "planted":
        docs = spark.createDataFrame(planted(), "doc_id long, text string").repartition(3)
    else:
        docs = odd if which == "odd" else documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str(r.doc_id) for r in sh.kept_documents(docs).collect()) == plain_kept(rows)


def test_pairs_that_fingerprints_misjudge(spark):
    docs = documents(spark, SF)
    kept = {r.doc_id for r in sh.kept_documents(docs).collect()}
    # 1/177 and 6/145 have 0.83 and lie over 6 bits apart; 155/192 have 0.76 and lie within.
    assert not {177, 145} & kept and {1, 6, 155, 192} <= kept


@pytest.mark.parametrize("each", [1, 256])
def test_shingles_are_counted_over_all_documents(spark, odd, none, each, monkeypatch):
    monkeypatch.setattr(jaccard, "EACH_PART", each)  # 1: nearly a block a document
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    sets = [(d, plain_set(t)) for d, t in rows]
    held = {}
    for _, s in sets:
        for x in s:
            held[x] = held.get(x, 0) + 1
    found = jaccard.prefixes(odd, 5, 0.8).collect()
    least = lambda n: n - -(-4 * n // 5) + 1 if n else 0
    want = [(d, len(s), own := sum(held[x] == 1 for x in s), max(0, least(len(s)) - own)) for d, s in sets]
    assert sorted((str(r.doc_id), r.n, r.skip, len(r.prefix)) for r in found) == sorted((str(d), *x) for d, *x in want)
    assert jaccard.prefixes(none, 5, 0.8).collect() == []


def test_fingerprints_give_the_first_links(spark, monkeypatch):
    docs = spark.createDataFrame(planted(), "doc_id long, text string").repartition(3)
    sets = {d: plain_set(t) for d, t in planted()}
    fps = {d: sh.fingerprint_of(jaccard.shingle_set(t)) for d, t in planted()}
    far = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    seen, given = [], []
    pairs_of, labels_of = sh.fingerprint_pairs, jaccard.node_labels

    def pairs(*args):
        found = pairs_of(*args)
        seen.extend(tuple(r) for r in found.collect())
        return found

    def labels(docs, bodies, links, *rest):
        given.extend(tuple(r) for r in links.collect())
        return labels_of(docs, bodies, links, *rest)

    monkeypatch.setattr(sh, "fingerprint_pairs", pairs)
    monkeypatch.setattr(jaccard, "node_labels", labels)
    assert sorted(str(r.doc_id) for r in sh.kept_documents(docs).collect()) == plain_kept(planted())
    # The smallest doc_id of those with equal sets is their node.
    assert sorted(given) == sorted(p for p in seen if like(*p)) and len(given) > 100
    forest = sh.Forest()
    for a, b in seen:
        assert far(a, b) <= 6
        forest.join(a, b)
    nodes = {s: d for d, s in sorted(sets.items(), reverse=True)}.values()
    assert all(forest.root(a) == forest.root(b) for a in nodes for b in nodes if a < b and far(a, b) <= 6)


def test_set_fingerprints():
    rng = random.Random(3)
    for n in (1, 2, 17, 70_000):
        h = [rng.getrandbits(64) for _ in range(n)]
        want = sum((2 * sum(x >> b & 1 for x in h) > n) << b for b in range(64))
        assert sh.fingerprint_of(np.array(h, np.uint64)) == want
    assert sh.fingerprint_of(np.zeros(0, np.uint64)) == 0
    # Without repeated shingles that is the operator's fingerprint.
    text = " ".join(f"w{i}" for i in range(50))
    assert sh.fingerprint_of(jaccard.shingle_set(text, 4)) == sh.fingerprint(text)


def test_parity_never_exceeds_the_difference():
    rng = random.Random(5)
    for n in (0, 1, 30, 2000):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: n // 2]) | {rng.getrandbits(64) for _ in range(n // 3)}
        x, y = (int.from_bytes(jaccard.parity(np.array(sorted(s), np.uint64))) for s in (a, b))
        assert (x ^ y).bit_count() <= len(a ^ b) and (x ^ y).bit_count() % 2 == len(a ^ b) % 2


def test_a_large_group_is_not_listed_pair_by_pair(spark, monkeypatch):
    """Short texts whose words come from a few choices: all share rare shingles, few are alike enough."""
    rng = random.Random(13)
    choices = [[f"w{at}x{i}" for i in range({0: 20, 24: 20, 6: 4, 12: 4, 18: 4}.get(at, 1))] for at in range(25)]
    texts = sorted({" ".join(map(rng.choice, choices)) for _ in range(400)})
    rng.shuffle(texts)
    rows, made = list(enumerate(texts)), []
    candidates = jaccard.candidates

    def counted(*args):
        found = candidates(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "candidates", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(r.doc_id) for r in sh.kept_documents(docs).collect()) == plain_kept(rows)
    assert sum(made) <= 10 * len(rows)


@pytest.mark.parametrize("groups, size, changed", [(30, 4, 4), (1, 100, 2), (1, 400, 2)])
def test_a_pair_is_no_row_for_each_shared_shingle(spark, groups, size, changed, monkeypatch):
    """Copies with some words changed share up to a hundred rare shingles: the rows made, before any are put together."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(100 * changed)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(len(base)), changed):
                copy[at] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows, made = list(enumerate(texts)), []
    candidates = jaccard.candidates

    def counted(postings, *args):
        with monkeypatch.context() as m:
            m.setattr(type(postings), "distinct", lambda df: df)
            every = candidates(postings, *args)
        made.append(every.count())
        return every.distinct()

    monkeypatch.setattr(jaccard, "candidates", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(r.doc_id) for r in sh.kept_documents(docs, distance=1).collect()) == plain_kept(rows)
    # Of a group all texts are alike: its pairs if they are few, else about two a text.
    assert 0 < sum(made) <= 4 * len(rows)
