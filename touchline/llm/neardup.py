"""Operator 5: near-duplicate documents by MinHash with tensored banding.

Two documents are linked when the Jaccard similarity of their full sets of
five-word shingles is at least 0.75; components are the groups of linked ones.

* Documents with equal sets form one class first; only one of them goes on, so a
  group of exact copies of any size is one row.
* Each class has two small collections of ``KEYS`` values, each value made of two
  minhashes (48 minhashes in all). Every pair of a value of the first and one of
  the second collection is a table key: 144 keys of four minhashes for the work
  of 48. A pair of similarity 0.75 has a key in common with a probability of
  0.9999; all candidates are verified on the full sets, so no link is false.
* Classes that share no value of the first collection with any other can't have
  a candidate and drop out before the keys are formed.
* Per key, one hub (the class with the most company) is verified against the
  others: a star, not all pairs. Verified links are joined to components. Members
  of a hub's keys that are still outside its component are then compared with all
  the other members, block by block of ``MEMBERS``, so no link is lost and no
  pairs are written out.

Hot keys: counts and hubs are combined before the shuffle, joins by key can be
split by adaptive execution, and the members of a hub are salted, about
``MEMBERS`` to a group. Nothing is collected; intermediate tables are written to the shared
checkpoint folder.

Defined results: null, empty and blank texts have no shingles, are linked with
nothing and keep their own id; fewer than five words make one shingle; a null
doc_id is its own group and kept; rows that repeat a doc_id are one document; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow import columns, map_batches
from touchline.llm.shingles import mix, pieces, shingle_sets
from touchline.llm.staging import Stage, with_ids

KEYS, SHINGLE = 12, 5
MEMBERS, MEMBER_SHINGLES = 256, 1 << 20  # of one hub that are verified together, and how many shingles they hold
MAX_ROUNDS = 60
_RNG = np.random.Generator(np.random.PCG64(5))
_A = _RNG.integers(1, 1 << 63, (2, KEYS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 63, (2, KEYS, 2), dtype=np.uint64)


def collections_of(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(2, KEYS, sets) values of the two collections; ``starts`` are those of non-empty sets."""
    out = np.zeros((2, KEYS, len(starts)), np.uint64)
    for side in range(2):
        for k in range(KEYS):
            value = np.full(len(starts), 2 * k + side + 1, np.uint64)
            for r in range(2):
                least = np.minimum.reduceat(flat * _A[side, k, r] + _B[side, k, r], starts)
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + least)
            out[side, k] = value
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, c1, c2, a, b``: set size, 128 bits that name the set, and the two collections (null for empty sets)."""

    def step(batches):
        for whole in batches:
            for batch in pieces(whole, 1):
                flat, bounds = shingle_sets(batch.column(1), SHINGLE)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                starts = bounds[:-1][full]
                c = np.zeros((2, len(n)), np.uint64)
                a = b = [None] * len(n)
                if len(full):
                    for j, seed in enumerate((1, 2)):
                        c[j, full] = np.add.reduceat(mix(flat + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)), starts)
                    both = collections_of(flat, starts).view(np.int64)
                    at = np.full(len(n), -1)
                    at[full] = np.arange(len(full))
                    a, b = ([both[s, :, i] if i >= 0 else None for i in at.tolist()] for s in range(2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in c), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "c1", "c2", "a", "b"],
                )

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, n_shingles long, c1 long, c2 long, a array<long>, b array<long>")


def _blocks(members: DataFrame) -> DataFrame:
    """``hub, last``: the number of the last block of each hub's ``members`` (hub, n), by their count and their shingles."""
    last = F.floor(F.greatest(F.count("*") / MEMBERS, F.sum("n") / MEMBER_SHINGLES))
    return members.groupBy("hub").agg(last.cast("int").alias("last"))


def _linked(pairs: DataFrame, texts: DataFrame, stage: Stage) -> DataFrame:
    """The ``pairs`` (x, hub, n of x) whose full sets are similar enough. Each hub's text goes once to every block of its members."""
    hubs = stage.write(_blocks(pairs))
    member = pairs.join(hubs, "hub").select("hub", F.pmod(F.xxhash64("x"), F.col("last") + 1).cast("int").alias("salt"), "x")
    member = member.join(texts.withColumnRenamed("doc_id", "x"), "x").select("hub", "salt", "x", "text")
    center = hubs.select("hub", F.explode(F.sequence(F.lit(0), "last")).alias("salt")).join(texts.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("x"), "text")
    dealt = member.unionByName(center).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("x").asc_nulls_first())

    def step(batches):
        now, sets = None, []
        for whole in batches:
            for batch in pieces(whole, 3):
                flat, bounds = shingle_sets(batch.column(3), SHINGLE)
                out = []
                for i, (hub, salt, x) in enumerate(zip(*columns(batch, "hub", "salt", "x"))):
                    own = flat[bounds[i] : bounds[i + 1]]
                    if (hub, salt) != now:
                        now, sets = (hub, salt), []
                    if x is None:
                        sets.append(own.copy())
                        continue
                    for s in sets:
                        lo, hi = sorted((len(s), len(own)))
                        if 4 * lo < 3 * hi:
                            continue
                        same = len(np.intersect1d(s, own, assume_unique=True))
                        if 100 * same >= 75 * (lo + hi - same):
                            out.append((x, hub))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], ["x", "hub"])

    return map_batches(dealt, step, "x long, hub long")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``doc_id, label`` for the ends of ``edges`` (x, hub): the smallest id that can be reached.

    Each round takes the least label of the neighbours and then the label of the label, so long chains shrink by halves."""
    both = stage.write(edges.union(edges.select(F.col("hub"), F.col("x"))).toDF("src", "dst").distinct())
    labels = stage.write(both.groupBy(F.col("dst").alias("doc_id")).agg(F.least(F.min("src"), F.first("dst")).alias("label")))
    kept = [labels]
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("doc_id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "doc_id").select("doc_id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("doc_id").alias("label"), F.col("label").alias("far"))
        after = stage.write(step.join(jump, "label", "left").select("doc_id", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = after.select("doc_id", "label")
        settled = after.filter("label <> was").isEmpty()
        stage.free(*kept, *([both] if settled else []))
        if settled:
            return labels
        kept = [after]
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _cross_links(families: DataFrame, texts: DataFrame, stage: Stage) -> DataFrame:
    """Links (x, hub) between components, from ``families`` (hub, doc_id, n, label, hub_label).

    Members outside the hub's component are compared with all members of the family. The family is dealt in blocks of about
    ``MEMBERS`` documents or ``MEMBER_SHINGLES`` shingles, and an outside member goes once to each block, where one index of the block counts what it shares with all."""
    outside = stage.write(families.filter("label <> hub_label").select("hub", "doc_id", "label"))
    inside = stage.write(families.join(outside.select("hub").distinct(), "hub", "left_semi").select("hub", "doc_id", "n", "label"))
    sizes = stage.write(_blocks(inside))
    blocks = inside.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), F.col("last") + 1).cast("int").alias("salt"), F.lit(0).alias("kind"), "doc_id", "label")
    asked = outside.join(sizes, "hub").select("hub", F.explode(F.sequence(F.lit(0), "last")).alias("salt"), F.lit(1).alias("kind"), "doc_id", "label")
    dealt = blocks.unionByName(asked).join(texts, "doc_id").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def step(batches):
        now, held, index = None, [], None
        for whole in batches:
            for batch in pieces(whole, 5):
                flat, bounds = shingle_sets(batch.column(5), SHINGLE)
                out = []
                for i, (hub, salt, kind, doc_id, label) in enumerate(zip(*columns(batch, "hub", "salt", "kind", "doc_id", "label"))):
                    own = flat[bounds[i] : bounds[i + 1]]
                    if (hub, salt) != now:
                        now, held, index = (hub, salt), [], None
                    if kind == 0:
                        held.append((own.copy(), doc_id, label))
                        continue
                    if index is None and held:
                        every = np.concatenate([h[0] for h in held])
                        order = np.argsort(every, kind="stable")
                        sizes = np.array([len(h[0]) for h in held])
                        index = every[order], np.repeat(np.arange(len(held)), sizes)[order], sizes
                    if index is None:
                        continue
                    every, owner, sizes = index
                    lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                    n = hi - lo
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    same = np.bincount(owner[at], minlength=len(held))
                    for j in np.flatnonzero(100 * same >= 75 * (sizes + len(own) - same)).tolist():
                        if held[j][2] != label:
                            out.append((doc_id, held[j][1]))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(2)], ["x", "hub"])

    return map_batches(dealt.select("hub", "salt", "kind", "doc_id", "label", "text"), step, "x long, hub long")


def near_duplicates(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    stage = stage or Stage(docs.sparkSession)
    sig = stage.write(signatures(docs))
    usable = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = stage.write(usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")))

    # classes with company in the first collection
    first = classes.select("doc_id", F.explode("a").alias("value"))
    company = first.groupBy("value").agg(F.count("*").alias("k")).filter("k > 1")
    degree = first.join(company, "value").groupBy("doc_id").agg(F.sum("k").alias("degree"))
    open_ = stage.write(classes.join(degree, "doc_id").select("doc_id", "n", "a", "b", (F.col("degree") + 16 * (F.col("copies") - 1)).alias("degree")))

    # tensored keys
    keys = F.explode(F.flatten(F.transform("a", lambda x: F.transform(F.col("b"), lambda y: F.xxhash64(x, y)))))
    rows = open_.select(keys.alias("key"), "doc_id", "n", "degree")
    hubs = rows.groupBy("key").agg(F.max(F.struct("degree", F.negate("doc_id").alias("m"), "n")).alias("h"), F.count("*").alias("k")).filter("k > 1")
    near = lambda a, b: 4 * F.least(a, b) >= 3 * F.greatest(a, b)
    shared = stage.write(rows.join(hubs.select("key", (-F.col("h.m")).alias("hub"), F.col("h.n").alias("hub_n")), "key").select("key", "doc_id", "n", "hub", "hub_n"))
    pairs = shared.filter((F.col("doc_id") != F.col("hub")) & near(F.col("n"), F.col("hub_n"))).select(F.col("doc_id").alias("x"), "hub", "n").distinct()
    pairs = stage.write(pairs)

    n_open = open_.count()
    texts = stage.write(with_ids(docs.select("doc_id", "text"), shared.select("doc_id").distinct(), "left_semi", n_open))
    links = stage.write(_linked(pairs, texts, stage))
    stage.free(open_, pairs)
    labels = components(links, stage)

    # families (all documents with a key of one hub) that still hold several components
    names = labels.select(F.col("doc_id").alias("hub"), F.col("label").alias("hub_label"))
    families = shared.select("hub", "doc_id", "n").distinct().join(labels, "doc_id", "left").join(names, "hub", "left")
    families = families.select("hub", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
    families = stage.write(families)
    found = stage.write(_cross_links(families, texts, stage))
    if not found.isEmpty():
        labels = components(links.unionByName(found), stage)
    stage.free(shared, texts, links, families, found)

    groups = classes.join(labels, "doc_id", "left").filter("copies > 1 or label is not null").select("c1", "c2", F.coalesce("label", "doc_id").alias("label"))
    out = sig.select("doc_id", "n_shingles", "c1", "c2").join(groups, ["c1", "c2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``docs`` without the documents whose group has a smaller id."""
    stage = stage or Stage(docs.sparkSession)
    gone = stage.write(near_duplicates(docs, stage).filter("not kept").select("doc_id").distinct())
    return with_ids(docs, gone, "left_anti")
