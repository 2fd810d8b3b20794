"""The exact Jaccard similarity of word-shingle sets behind the SimHash near-dedup: a check of its pairs, and the pairs that
fingerprints miss, by rarest-first prefixes, parity bits and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ROWS_AT_ONCE, arrow_batches, arrow_schema, ship, shuffle_partitions, staged
from corpusloom.llm.components import connected_components

SEED = 42
THRESHOLD = 0.8
#: Shingles are counted in parts by hash: about PART bytes of text a part, at least SPREAD parts a shuffle partition.
PART, SPREAD = 1 << 25, 4
#: Documents travel in blocks of about EACH_PART shingles a part, MOST_SHINGLES (but for one long text) and MOST_DOCS at most.
EACH_PART, MOST_SHINGLES, MOST_DOCS = 256, 1 << 19, 1 << 14
#: In each round the members of a shared shingle's group up to this place are held against those behind them; then all.
#: The rounds end early with all pairs under different labels, once they are at most EACH a posting.
PIVOTS = (2, 16, 128)
EACH = 8
#: Parity bits of a set.
PARITY = 512
#: Shingles before it that a posting brings along, to tell whether two sets have met in an earlier group.
BEFORE = 4


def shingle_set(text: str | None, words: int = 5):
    """The distinct XXH64 (seed 42) of a text's word shingles, ascending; words and short texts as in ``simhash.fingerprint``."""
    import numpy as np
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, len(parts) - words + 1))


def body_of(shingles) -> int:
    """What equal sets share: XXH64 of the set, as a signed 64-bit number."""
    import xxhash

    h = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


#: What a block lists of its documents.
DOCUMENTS = "doc_ids array<long>, bodies array<long>, sizes array<int>, fps array<long>, bits array<binary>"


def parity(shingles) -> bytes:
    """PARITY bits, each the parity of the shingles it stands for: two sets differ in at least as many shingles as bits."""
    import numpy as np

    return np.packbits(np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def blocks(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """The shingles of the documents, a block of documents at a time.

    A row a block and part has the low 32 bits of the shingles of that part and the place of each one's document in the
    block.  A row a block, its part below zero, has the documents: doc_id, body, number of shingles, SimHash and parity bits.
    """
    schema = f"block long, part int, keys binary, places binary, {DOCUMENTS}"
    target = arrow_schema(schema)
    most = min(MOST_SHINGLES, EACH_PART * parts)
    rows_at_once = ROWS_AT_ONCE

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        from corpusloom.llm.simhash import fingerprint_of

        task, made = TaskContext.get().partitionId(), 0

        def block(ids, sets):
            sizes = [len(s) for s in sets]
            bodies = [body_of(s) for s in sets]
            fps = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            every = np.concatenate(sets)
            # Named by place and content: a task that runs again with other rows leaves blocks that lack parts, which raises.
            name = int(np.array([xxhash.xxh64_intdigest(repr((task, made, ids, bodies)), SEED)], np.uint64).view(np.int64)[0])
            part = ((every >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, place = every[order].astype(np.uint32), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
            first, last = group_edges(part[order]) if len(part) else ([], [])
            found = part[order][first].tolist() if len(part) else []
            spans = list(zip(first, last, strict=True))
            none = [None] * len(spans)
            columns = [
                [name] * (len(spans) + 1),
                [*found, -1 - name % parts],
                [*(key[a:b].tobytes() for a, b in spans), None],
                [*(place[a:b].tobytes() for a, b in spans), None],
                [*none, ids],
                [*none, bodies],
                [*none, sizes],
                [*none, fps],
                [*none, [parity(s) for s in sets]],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        ids, sets, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, rows_at_once):
                for doc_id, text in zip(*(c.to_pylist() for c in b.slice(at, rows_at_once).columns), strict=True):
                    ids.append(doc_id)
                    sets.append(shingle_set(text, words))
                    held += len(sets[-1])
                    if held >= most or len(ids) >= MOST_DOCS:
                        yield block(ids, sets)
                        ids, sets, held, made = [], [], 0, made + 1
        if ids:
            yield block(ids, sets)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def row_groups(batches):
    """Lists of rows that are alike in their first column, by which the batches are sorted."""
    held = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shared_shingles(dealt: DataFrame) -> DataFrame:
    """The rows of ``blocks`` with only those shingles that a second document holds, and how many documents do (65,535 at most).

    ``total`` is the number of shingles before.  A part of the shingles is one group: hashes deal them evenly.
    """
    schema = f"block long, part int, keys binary, places binary, counts binary, total int, {DOCUMENTS}"
    target = arrow_schema(schema)
    dealt = dealt.select("part", "block", "keys", "places", "doc_ids", "bodies", "sizes", "fps", "bits")
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "part").sortWithinPartitions("part")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        for rows in row_groups(batches):
            if rows[0][0] < 0:
                yield batch([(block, part, None, None, None, 0, *documents) for part, block, _, _, *documents in rows])
                continue
            keys = [np.frombuffer(r[2], np.uint32) for r in rows]
            _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            n = np.minimum(n, 65_535).astype(np.uint16)[at]
            out, start = [], 0
            for (part, block, _, places, *_), key in zip(rows, keys, strict=True):
                count = n[start : start + len(key)]
                start += len(key)
                some = count > 1
                out.append((block, part, key[some].tobytes(), np.frombuffer(places, np.uint16)[some].tobytes(), count[some].tobytes(), len(key), None, None, None, None, None))
            yield batch(out)

    return dealt.mapInArrow(work, schema)


def prefixes(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, body, n, fp, bits, skip, prefix): a text's set by name, its size, SimHash, parity bits and rarest n - ceil(threshold * n) + 1 shingles, rarest first.

    The first ``skip`` of the set are in no other document and are not listed.  Documents are counted exactly, all of them; a
    shingle is named by its part and 32 bits, and names that fall together only add candidates.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    parts = min(max(SPREAD * shuffle_partitions(spark), size // PART), 1 << 30)
    shared = shared_shingles(blocks(docs, words, parts)).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block")
    schema = "doc_id long, body long, n int, fp long, bits binary, skip int, prefix array<long>"
    target = arrow_schema(schema)

    def work(batches):
        import math

        import numpy as np
        import pyarrow as pa

        for rows in row_groups(batches):
            documents = [r[6:] for r in rows if r[1] < 0]
            rows = [r for r in rows if r[1] >= 0]
            if len(documents) != 1 or sum(documents[0][2]) != sum(r[5] for r in rows):
                raise RuntimeError("a block of documents came back in parts: the input changed between two runs of a task")
            doc_ids, bodies, sizes, fps, bits = documents[0]
            keys = [np.frombuffer(r[2], np.uint32).astype(np.int64) | r[1] << 32 for r in rows]
            s, place, count = (
                np.concatenate([*found, np.zeros(0, kind)])
                for found, kind in ((keys, np.int64), ([np.frombuffer(r[3], np.uint16) for r in rows], np.uint16), ([np.frombuffer(r[4], np.uint16) for r in rows], np.uint16))
            )
            order = np.lexsort((s, count, place))
            s, edges = s[order], np.searchsorted(place[order], np.arange(len(sizes) + 1)).tolist()
            skips, out = [], []
            for n, a, b in zip(sizes, edges[:-1], edges[1:], strict=True):
                length = n - math.ceil(threshold * n - 1e-9) + 1 if n else 0
                skips.append(n - (b - a))
                out.append(s[a : a + max(0, length - skips[-1])])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((doc_ids, bodies, sizes, fps, bits, skips, out), target, strict=True)], schema=target)

    return shared.mapInArrow(work, schema)


def grouped(batches, columns: int):
    """Arrow batches sorted by their first column as lists of numpy columns that hold whole groups; parity bits are rows of uint64, lists rows of their numbers."""
    import numpy as np
    import pyarrow as pa

    def column(c):
        if pa.types.is_binary(c.type):
            return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1)
        if pa.types.is_list(c.type):
            return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        return c.to_numpy(zero_copy_only=False)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [column(b.column(i)) for i in range(columns)]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        # The last group may go on in the next batch.
        start = int(np.argmax(held[0] == held[0][-1]))
        if start:
            yield [x[:start] for x in held]
            held = [x[start:] for x in held]
    if held:
        yield held


def group_edges(key):
    """(first, last) of each run of equal keys."""
    import numpy as np

    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])


def shared_postings(bodies: DataFrame) -> DataFrame:
    """(s, node, n, at) of the prefix shingles that at least two bodies hold; ``at`` is the place in its prefix."""
    schema = "s long, node long, n int, at int"
    target = arrow_schema(schema)
    dealt = bodies.select("node", "n", "skip", F.posexplode("prefix").alias("at", "s")).select("s", "node", "n", (F.col("at") + F.col("skip")).alias("at"))
    dealt = dealt.repartition(shuffle_partitions(bodies.sparkSession), "s").sortWithinPartitions("s")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for columns in grouped(batches, 4):
            first, last = group_edges(columns[0])
            keep = np.repeat(last - first > 1, last - first)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], type=f.type) for x, f in zip(columns, target, strict=True)], schema=target)

    return dealt.mapInArrow(work, schema)


def candidates(postings: DataFrame, low: int, high: int | None, threshold: float) -> DataFrame:
    """(u, v): pairs of nodes under different labels that a group holds and whose sizes, places and parity bits allow the threshold.

    A pair is due in the group of the first shingle that both prefixes hold, where all they share is still to come.  The places
    are held to that, and those who both bring a shingle that came before have met: a pair does not
    become a row again for each shingle it shares.
    Sets at the threshold differ in (1 - threshold) / (1 + threshold) of their shingles at most, and so do their parity bits:
    those members of a large group that only look alike by a few shingles are told apart before they become rows.  The first of a pair, by node, has a place from ``low`` up to ``high`` in the group; None stands for the end.
    """
    target = arrow_schema("u long, v long")
    dealt = postings.repartition(shuffle_partitions(postings.sparkSession), "s").sortWithinPartitions("s", "node")

    def work(batches):
        import numpy as np

        def pairs(i, j, node, n, at, label, bits, before):
            a, b = n[i].astype(np.int64), n[j].astype(np.int64)
            fit = (label[i] != label[j]) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
            fit &= np.minimum(a - at[i], b - at[j]) >= threshold / (1 + threshold) * (a + b) - 1e-9
            i, j, most = i[fit], j[fit], (a + b)[fit] * (1 - threshold) / (1 + threshold) + 1e-9
            near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= most
            i, j = i[near], j[near]
            near = np.ones(len(i), bool)
            for x in range(before.shape[1]):
                # Below zero: nothing came before.
                met = (before[i, x, None] == before[j]).any(axis=1) & (before[i, x] >= 0)
                near &= ~met
            return np.minimum(node[i], node[j])[near], np.maximum(node[i], node[j])[near]

        for s, *columns in grouped(batches, 7):
            first, last = group_edges(s)
            two = first[last - first == 2] if low == 0 else first[:0]
            some = [pairs(two, two + 1, *columns)]
            label = columns[3]
            for a, b in zip(first[last - first > 2].tolist(), last[last - first > 2].tolist(), strict=True):
                if b - a - 1 <= low or (label[a:b] == label[a]).all():
                    continue
                if high is not None:
                    for i in range(a + low, min(a + high, b - 1)):
                        j = np.arange(i + 1, b)
                        some.append(pairs(np.full(len(j), i), j, *columns))
                    continue
                # A label's members against those of later labels: as many steps as pairs under different labels.
                order = a + np.argsort(label[a:b], kind="stable")
                starts, ends = group_edges(label[order])
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    one, rest = order[x:y], order[y:]
                    if len(rest) < len(one):
                        one, rest = rest, one
                    for i in one.tolist():
                        j = rest[np.minimum(rest, i) >= a + low]
                        some.append(pairs(np.full(len(j), i), j, *columns))
                        if len(some) > 1024:
                            yield batch(some)
                            some = []
            yield batch(some)

    def batch(some):
        import numpy as np
        import pyarrow as pa

        columns = [np.concatenate([p[k] for p in some]) if some else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=target)

    return dealt.mapInArrow(work, "u long, v long").distinct()


def shared_prefixes(postings: DataFrame, bodies: DataFrame) -> DataFrame:
    """(node, n, some, bits): the shingles of a node's prefix that other prefixes hold, by place, and its parity bits.

    Each has its place and the BEFORE shingles that come before it in ``some``; -1 stands where there are fewer.
    """
    found = postings.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("found"))
    before = lambda i: F.array(*[F.coalesce(F.get("found", i - k)["s"], F.lit(-1)) for k in range(1, BEFORE + 1)])
    some = found.select("node", "n", F.transform("found", lambda x, i: F.struct(x["s"].alias("s"), x["at"].alias("at"), before(i).alias("before"))).alias("some"))
    return some.join(bodies.select("node", "bits"), "node")


def possible(pairs: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    """The (u, v) that may have the threshold by what their prefixes share; drops no pair that has it.

    What two sets share beyond both prefixes lies, in the one whose prefix ends first, behind that prefix.
    """
    one = shared.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("some.s").alias("pu"))
    two = shared.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("some.s").alias("pv"))
    rest = F.ceil(F.lit(threshold) * F.greatest("nu", "nv") - 1e-9) - 1
    # Shingles of one document whose names fall together count as often as they may be shared.
    twice = F.least(*(F.size(p) - F.size(F.array_distinct(p)) for p in ("pu", "pv")))
    enough = F.size(F.array_intersect("pu", "pv")) + twice + rest >= F.lit(threshold / (1 + threshold)) * (F.col("nu") + F.col("nv")) - 1e-9
    return pairs.join(two, "v").join(one, "u").filter(enough).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (u, v) whose sets have that Jaccard similarity."""
    target = arrow_schema("u long, v long")
    full = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], schema=target)

    return full.select("u", "v", "su", "sv").mapInArrow(work, "u long, v long")


def shingle_sets(docs: DataFrame, bodies: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the whole sets of ``nodes``, from the document that names each."""
    wanted = bodies.select("body", "node", "first").join(nodes, "node", "left_semi")
    ids = wanted.select("first").distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("text")
    schema = "body long, shingles binary"

    def work(texts):
        found = [shingle_set(t, words) for t in texts]
        return [body_of(s) for s in found], [s.tobytes() for s in found]

    # Rows that share an id, or have none, bring other bodies too: the join leaves those out.
    each = texts.mapInArrow(arrow_batches(work, schema), schema).groupBy("body").agg(F.first("shingles").alias("shingles"))
    return each.join(wanted.select("body", "node"), "body").select("node", "shingles")


def unlinked_pairs(placed: DataFrame) -> tuple[int, int]:
    """The pairs under different labels in all groups, and the postings."""
    labelled = placed.groupBy("s", "label").agg(F.count(F.lit(1)).alias("n"))
    each = labelled.groupBy("s").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    found = each.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).head()
    return int(found[0] or 0), int(found[1] or 0)


def checked(pairs: DataFrame, docs: DataFrame, bodies: DataFrame, words: int, threshold: float) -> DataFrame:
    """The (u, v) whose whole sets, made anew from the texts, have that Jaccard similarity."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = staged(shingle_sets(docs, bodies, nodes, words), "jaccard-sets")
    return staged(verified(pairs, sets, threshold), "jaccard-links")


def node_labels(docs: DataFrame, bodies: DataFrame, links: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, label) of the ``bodies`` (body, first, node, n, bits, skip, prefix) that pairs at the threshold connect; label is the smallest node.

    ``links`` (u, v) are pairs known to have the threshold; all others are found here.  They share a prefix shingle.  A
    group's first members are pivots and are held against the rest; what is connected already brings no
    pairs, so that a large group of copies is not listed pair by pair.
    """
    postings = staged(shared_postings(bodies), "jaccard-postings")
    shared = staged(shared_prefixes(postings, bodies), "jaccard-shared")

    def labelled(links):
        # A node has one row here: the join makes no more rows than there are nodes, however often they share shingles.
        labels = connected_components(links)
        named = shared.join(labels, "node", "left").select("node", "n", "bits", F.coalesce("label", "node").alias("label"), F.inline("some"))
        placed = staged(named.select("s", "node", "n", "at", "label", "bits", "before"), "jaccard-placed")
        return labels, placed, *unlinked_pairs(placed)

    labels, placed, pairs, n = labelled(links)
    low = 0
    for high in (*PIVOTS, None):
        if not pairs:
            break
        if pairs <= EACH * n:
            high = None
        found = staged(possible(candidates(placed, low, high, threshold), shared, threshold), "jaccard-pairs")
        low = high
        new = None if found.isEmpty() else checked(found, docs, bodies, words, threshold)
        # A round that links nothing leaves labels and groups as they are.
        if new is not None and not new.isEmpty():
            links = links.unionByName(new)
            if high is None:
                labels = connected_components(links)
            else:
                labels, placed, pairs, n = labelled(links)
        if high is None:
            break
    return labels
