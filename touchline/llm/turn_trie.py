"""Operator 11: the prefix trie of conversations by partition refinement.

All conversations start in one class. A round takes the next turns of the active
conversations and splits each class by them; a class is named after its smallest
conversation, so (conversation, depth) names a node of the trie. Conversations
alone in their class retire: what they still have to say is a unary chain, which
their length alone describes. The first round takes one turn and each later one
twice as many as the one before (``MOST_TURNS`` at most), so conversations that
share hundreds of turns need few rounds. At the end the values are folded back:
each node's own value goes to its smallest conversation, is summed up along that
conversation towards the root, and then over the conversations of each node.

Skew: turns are numbered by a range sort that also splits a single conversation
over partitions, sums are made before shuffling, joins of large tables are sort-
merge joins whose large partitions Spark splits, chains are unrolled from pieces
of ``PIECE`` turns, and sums along long conversations go by segments of that
many turns. The ids of a node's ends are joined in pieces of at most 65,536 ids;
nodes with more are hashed piece by piece as their rows stream past, since a
digest can only be taken in order. Every round is a written table.

Defined results: rows with a null conv_id belong to no conversation; a null role
or text is empty; turns are ordered by turn (null first), equal ones by role and
text, and repeated rows are turns of their own; other columns are ignored; an
empty table has no root. Conversations without turns end in the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.arrow import map_batches
from touchline.llm.staging import Stage

MOST_TURNS = 64  # of a conversation in one round
PIECE = 4096
BROADCAST_CLASSES = 200_000  # of a round, about 80 bytes each
FAMILY, LONGEST = 5, 9  # conversations of a family share up to LONGEST - 1 first turns of its first member
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, stage: Stage) -> DataFrame:
    """``conv_id, pos, digest, n_bytes``: turns numbered from 1, each known by a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    own = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ranged = stage.write(own.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("conv_id", "part", "first", before.alias("before"))
    # within a partition the turns of a conversation stand together and "at" counts them
    return stage.write(ranged.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("pos"), "digest", "n_bytes"))


def rebuilt(turns: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, digest, n_bytes`` of the rebuilt conversations, and ``conv_id, len`` of them all.

    The first h turns of c - c % 5 stand before c's own turns after the first h, for h = crc32(c) % 9."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(LONGEST)).cast("int")
    convs = own.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lead = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = convs.join(heads, "base", "left").withColumn("lead", lead).withColumn("len", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stage.write(convs.select("conv_id", "base", "h", "lead", "len"))
    first = turns.filter(F.col("pos") < LONGEST).withColumnRenamed("conv_id", "base")
    taken = convs.filter("lead > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lead"))).alias("pos")).join(first, ["base", "pos"])
    kept = turns.join(convs.select("conv_id", "h", "lead"), "conv_id").filter("pos > h")
    whole = taken.select("conv_id", F.col("pos").alias("depth"), "digest", "n_bytes").unionByName(kept.select("conv_id", (F.col("lead") + F.col("pos") - F.col("h")).alias("depth"), "digest", "n_bytes"))
    return stage.write(whole), convs.select("conv_id", "len")


def split(active: DataFrame, turns: DataFrame, depth: int, k: int, stage: Stage) -> DataFrame:
    """``conv_id, depth, label, n, n_bytes`` after splitting the classes (conv_id, label) by turns depth+1 to depth+k; classes of one are left out."""
    near = turns.filter((F.col("depth") > depth) & (F.col("depth") <= depth + k))
    ahead = active.join(near, "conv_id").groupBy("conv_id", "label").agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "n_bytes"))).alias("next"))
    # the name of a path: a digest of the digests of its turns since the last round
    path = F.transform("next", lambda t, i: F.struct(t["depth"].alias("depth"), t["n_bytes"].alias("n_bytes"), F.unhex(F.sha2(F.to_binary(F.array_join(F.transform(F.slice("next", 1, i + 1), lambda s: F.hex(s["digest"])), ""), F.lit("hex")), 256)).alias("path")))
    steps = stage.write(ahead.select("conv_id", "label", F.inline(path)))
    keys = ["label", "depth", "path"]
    classes = stage.write(steps.groupBy(*keys).agg(F.min("conv_id").alias("own"), F.count("*").alias("n")).filter("n > 1"))
    named = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes.hint("merge")  # beyond that Spark splits the partitions of large classes
    out = stage.write(steps.join(named, keys).select("conv_id", "depth", F.col("own").alias("label"), "n", "n_bytes"))
    stage.free(steps, classes)
    return out


def refine(turns: DataFrame, convs: DataFrame, stage: Stage) -> DataFrame | None:
    """``conv_id, depth, label, n, n_bytes``: the nodes of each conversation that it shares with others."""
    root = convs.agg(F.min("conv_id").alias("label"), F.count("*").alias("n")).first()
    if root.n < 2:
        return None
    shared = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root.label).alias("label"), F.lit(root.n).alias("n"), F.lit(0).cast("long").alias("n_bytes"))
    rounds, depth, k = [stage.write(shared)], 0, 1
    while not (active := rounds[-1].filter(F.col("depth") == depth).select("conv_id", "label")).isEmpty():
        rounds.append(split(active, turns, depth, k, stage))
        depth, k = depth + k, min(2 * k, MOST_TURNS)
    whole = rounds[0]
    for r in rounds[1:]:
        whole = whole.unionByName(r)
    return whole


def sum_towards_root(values: DataFrame) -> DataFrame:
    """``conv_id, depth, below``: of ``conv_id, depth, own``, own summed from each depth of a conversation to its last."""
    piece = F.floor(F.col("depth") / PIECE)
    totals = values.groupBy("conv_id", piece.alias("piece")).agg(F.sum("own").alias("total"))
    later = F.coalesce(F.sum("total").over(Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("own").over(Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")))
    return values.withColumn("piece", piece).withColumn("inside", inside).join(totals.select("conv_id", "piece", later.alias("later")), ["conv_id", "piece"]).select("conv_id", "depth", (F.col("inside") + F.col("later")).alias("below"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """``label, depth, ends_sha256`` of ``label, depth, conv_id``: digests of the ascending ids joined by commas."""
    key = ["label", "depth"]
    pieces = ends.groupBy(*key, F.shiftright("conv_id", 16).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    sized = pieces.groupBy(*key).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    few = sized.filter("n = 1").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    many = pieces.join(sized.filter("n > 1").select(*key), key).repartition(*key).sortWithinPartitions(*key, "piece")

    def step(batches):
        now, state = None, None
        for batch in batches:
            for label, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (label, depth) != now:
                    if state:
                        yield row(now, state)
                    now, state = (label, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row(now, state)

    def row(key, state):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["label", "depth", "ends_sha256"])

    return few.unionByName(map_batches(many.select(*key, "ids"), step, "label long, depth long, ends_sha256 string"))


def chains(tails: DataFrame) -> DataFrame:
    """The nodes that belong to one conversation: depths f + 1 to len of each, below the node ``label`` at depth f."""
    text = lambda c: F.sha2(c.cast("string"), 256)
    pieces = tails.filter("len > f").select("*", F.explode(F.sequence(F.col("f") + 1, F.col("len"), F.lit(PIECE).cast("long"))).alias("from"))
    each = pieces.select("conv_id", "f", "label", "len", F.explode(F.sequence("from", F.least(F.col("from") + (PIECE - 1), F.col("len")))).alias("depth"))
    last = F.col("depth") == F.col("len")
    return each.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("f") + 1, F.col("label")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, text(F.col("conv_id"))).otherwise(EMPTY).alias("ends_sha256"),
    )


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def trie(conversations: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: one row a node of the rebuilt conversations."""
    stage = stage or Stage(conversations.sparkSession)
    turns, convs = rebuilt(numbered(conversations, stage), stage)
    shared = refine(turns, convs, stage)
    if shared is None:  # one conversation or none: a chain from the root on
        return chains(convs.select("conv_id", F.lit(-1).cast("long").alias("f"), F.lit(None).cast("long").alias("label"), "len"))
    leave = shared.groupBy("conv_id").agg(F.max(F.struct("depth", "label")).alias("l"))
    tails = stage.write(leave.select("conv_id", F.col("l.depth").alias("f"), F.col("l.label").alias("label")).join(convs, "conv_id"))

    node = ["label", "depth"]
    heads = shared.filter("conv_id = label")
    above = shared.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent_conv_id"))
    nodes = stage.write(heads.join(above, ["conv_id", "depth"], "left").select("label", "depth", "parent_conv_id", "n", "n_bytes"))
    below = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("label"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_shared"))
    alone = tails.groupBy("label", F.col("f").alias("depth")).agg(F.count_if(F.col("len") > F.col("f")).alias("n_alone"))
    children = F.coalesce("n_shared", F.lit(0)) + F.coalesce("n_alone", F.lit(0))
    nodes = stage.write(nodes.join(below, node, "left").join(alone, node, "left").withColumn("n_children", children).drop("n_shared", "n_alone"))

    # leaves: the ends of chains, and shared nodes without children, which count with their smallest conversation
    leaves = tails.filter("len > f").select("conv_id").unionByName(nodes.filter("n_children = 0").select(F.col("label").alias("conv_id")))
    leaves = leaves.withColumn("leaf", F.lit(1))
    saved = sum_towards_root(shared.join(heads.select("conv_id").distinct(), "conv_id").select("conv_id", "depth", F.when(F.col("conv_id") == F.col("label"), (F.col("n") - 1) * F.col("n_bytes")).otherwise(0).alias("own")))
    folded = shared.join(leaves, "conv_id", "left").join(saved, ["conv_id", "depth"], "left").groupBy(*node).agg(_total(F.col("leaf")).alias("n_leaves"), _total(F.col("below")).alias("saved_tokens"))
    ends = ends_digest(tails.filter("len = f").select("label", F.col("f").alias("depth"), "conv_id"))
    inner = nodes.join(folded, node).join(ends, node, "left")
    inner = inner.select(
        F.col("label").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
    return inner.unionByName(chains(tails))
