"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance or Jaccard similarity, components."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import jaccard
from corpusloom.llm.common import arrow_batches, arrow_schema, documents, ship, shuffle_partitions, staged
from corpusloom.llm.components import connected_components, with_nodes

BITS = 64
SEED = 42
#: Shingles counted at a time: bounds the memory of a long text.
CHUNK = 1 << 15
#: Distinct fingerprints under a masked value that are walked pair by pair; more are cut into blocks once more.
DENSE = 1024


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, repeats included; a text without words has 0.

    Only A-Z are lowered; words are runs without the six ASCII blanks; fewer words than a shingle holds
    are one shingle.  A bit is set if it is in over half of the shingles' XXH64 (UTF-8, seed 42).
    """
    import numpy as np
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(whole, SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")
    return int(value[0])


def fingerprint_of(shingles) -> int:
    """The SimHash of distinct shingles, given as their hashes (uint64): equal sets have equal ones, and no shingles have 0."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = shingles[at : at + CHUNK].astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint as a signed 64-bit number.  A map, no shuffle."""
    ship(docs.sparkSession)
    schema = "doc_id long, fp long"

    def work(doc_ids, texts):
        return doc_ids, [f - (1 << 64) if f >> 63 else f for f in (fingerprint(t, words) for t in texts)]

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(work, schema), schema)


def block_masks(n: int, distance: int) -> list[int]:
    """Masks such that two fingerprints within ``distance`` agree under one of them.

    The bits are cut into blocks; ``distance`` differing bits leave all but ``distance`` blocks alike, and each
    mask is one choice of those.  More blocks mean more masks of more bits: the fewest with which ``n``
    random fingerprints leave at most eight under a masked value.  Any number of blocks finds all pairs.
    """
    for blocks in range(distance + 1, 2 * distance + 1):
        if n >> ((blocks - distance) * (BITS // blocks)) <= 8:
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def dense_links(values, mask: int, distance: int) -> list[tuple[int, int]]:
    """``spanning_links`` of values that agree under ``mask``, at less than all pairs' cost.

    Large groups are cut by the bits outside the mask into distance + 1 blocks: a pair within ``distance`` agrees in one
    of those too, so that each block's groups of equal bits hold every pair between them.
    """
    import numpy as np

    if len(values) <= DENSE:
        return spanning_links(values, distance)
    free = [b for b in range(BITS) if not mask >> b & 1]
    out = []
    for i in range(distance + 1):
        block = np.uint64(sum(1 << b for b in free[i :: distance + 1]))
        order = np.argsort(values & block, kind="stable")
        held = values[order]
        cut = np.flatnonzero((held[1:] & block) != (held[:-1] & block)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(held)], strict=True):
            if b - a > 1:
                out += spanning_links(held[a:b], distance)
    return out


def spanning_links(values, distance: int) -> list[tuple[int, int]]:
    """Links that connect what pairs of ``values`` (distinct uint64) within ``distance`` connect, one for each value at most.

    Grows one component at a time: whatever is near a reached value is reached and leaves the rest, so that
    a dense group costs a few passes over it and no pair is listed twice.
    """
    import numpy as np

    rest, links = np.asarray(values, dtype=np.uint64), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                links += [(int(at), int(v)) for v in rest[near]]
                todo += list(rest[near])
                rest = rest[~near]
    return links


class Forest:
    """Union-find that keeps the links which joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(fps: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """(u, v): enough links between the nodes of ``fps`` (fp, node; distinct fingerprints) to connect all pairs within ``distance``.

    Copies are one fingerprint here, and a masked value's group is walked in one task; what it can
    hold is bounded by how many distinct fingerprints lie near each other, not by the number of rows.
    """
    parts = shuffle_partitions(fps.sparkSession)
    masks = block_masks(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    dealt = fps.select("fp", "node", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp", "node")
    dealt = dealt.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "fp")
    target = arrow_schema("u long, v long")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        forest = Forest()

        def linked(mask, key, fp, node):
            """The new links of whole groups."""
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            two = first[last - first == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            found = list(zip(node[near].tolist(), node[near + 1].tolist(), strict=True))
            for a, b in zip(first[last - first > 2], last[last - first > 2], strict=True):
                pairs = dense_links(fp[a:b], masks[mask[a]], distance)
                if pairs:
                    # Ascending within a group, as sorted unsigned.
                    order = np.argsort(fp[a:b])
                    at = order[np.searchsorted(fp[a:b], np.array(pairs, np.uint64), sorter=order)]
                    found += [tuple(p) for p in node[a:b][at].tolist()]
            found = [p for p in found if forest.join(*p)]
            u = np.array([p[0] for p in found], dtype=np.int64)
            v = np.array([p[1] for p in found], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=target)

        held = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now[2] = now[2].view(np.uint64)
            if not b.num_rows:
                continue
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            # The last group may go on in the next batch.
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            start = int(np.argmax(same))
            if start:
                yield linked(*[x[:start] for x in held])
                held = [x[start:] for x in held]
        if held:
            yield linked(*held)

    return dealt.mapInArrow(work, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The component of each document among fingerprints that differ in ``distance`` bits at most.

    Reads doc_id and text.  Returns doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest
    doc_id reachable, itself included.  A null text counts as empty; texts without words all have
    fingerprint 0 and are linked like others.  Repeated rows give repeated rows; a null doc_id never names
    a component unless it stands alone there.  Empty in, empty out.
    """
    rows = staged(fingerprints(docs, words), "simhash-rows")
    fps, above = with_nodes(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), rows)
    fps = staged(fps, "simhash-distinct")
    labels = connected_components(links(fps.select("fp", "node"), fps.count(), distance))
    label = F.coalesce("label", "node")
    known = fps.join(labels, "node", "left").select("fp", F.when(label < above, label).alias("component_id"))
    # A fingerprint has one row on the right: adaptive execution splits a hot one's rows on the left.
    known = staged(known, "simhash-components")
    return rows.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_pairs(bodies: DataFrame, distance: int) -> DataFrame:
    """(u, v): pairs of the ``bodies`` (node, fp, n) that connect all whose fingerprints differ in ``distance`` bits at most.

    Sets without shingles are like no other set and bring no pairs.
    """
    bodies = bodies.filter("n > 0").select("node", "fp")
    fps = staged(bodies.groupBy("fp").agg(F.min("node").alias("node")), "simhash-distinct")
    near = links(fps.select("fp", "node"), fps.count(), distance).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    same = bodies.select("fp", F.col("node").alias("v")).join(fps.withColumnRenamed("node", "u"), "fp").filter(F.col("u") < F.col("v"))
    return near.unionByName(same.select("u", "v")).distinct()


def near_copies(docs: DataFrame, words: int = 5, threshold: float = jaccard.THRESHOLD, distance: int = 6) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that pairs of sets with a Jaccard similarity of ``threshold`` or more reach.

    SimHash fingerprints within ``distance`` bits, found by pigeonhole masks, are the first pairs; those whose whole sets
    have the threshold link.  Pairs at 0.8 differ in 4 to 14 bits, more than such masks can cover: what is not
    connected then is searched exactly (``jaccard.node_labels``).  Exact but for collisions of 64-bit hashes.
    Reads doc_id and text, gives a row a row.  Null texts and texts without words have the empty set and are alike.  A
    null doc_id names no component unless it stands alone there.
    """
    rows = staged(jaccard.prefixes(docs, words, threshold), "simhash-rows")
    # Equal sets have the rest alike.
    alike = [F.first(c).alias(c) for c in ("n", "fp", "bits", "skip", "prefix")]
    bodies, above = with_nodes(rows.groupBy("body").agg(F.min("doc_id").alias("first"), *alike), rows)
    bodies = staged(bodies, "simhash-bodies")
    pairs = staged(fingerprint_pairs(bodies, distance), "simhash-pairs")
    near = jaccard.checked(pairs, docs, bodies, words, threshold)
    label = F.coalesce("label", "node")
    known = bodies.select("body", "node").join(jaccard.node_labels(docs, bodies, near, words, threshold), "node", "left")
    known = staged(known.select("body", F.when(label < above, label).alias("component_id")), "simhash-components")
    # A body has one row on the right: adaptive execution splits a hot one's rows on the left.
    return rows.select("doc_id", "body").join(known, "body").select("doc_id", "component_id")


def kept_documents(docs: DataFrame, words: int = 5, threshold: float = jaccard.THRESHOLD, distance: int = 6) -> DataFrame:
    """One document of each component of near copies, that with the smallest doc_id, with the columns of ``docs``.

    Links are checked by the exact Jaccard similarity of word shingles.  Only the doc_ids that go take part in
    the join.  Rows that share a doc_id stay or go together; rows without one stay.
    """
    placed = near_copies(docs, words, threshold, distance)
    gone = placed.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    gone = staged(gone, "simhash-gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
