"""Operator 9: nearest neighbours by inner product with a vantage-point tree per shard.

Inner products become distances by one more coordinate: with M the largest norm
of a shard, a vector x gets the coordinate sqrt(M^2 - |x|^2) and a query gets 0,
so the squared distance is |q|^2 + M^2 - 2 q.x and nearest means largest product.
A node of the tree splits its vectors by the median distance to a vantage point;
by the triangle inequality a branch is skipped when it lies farther than the
k-th best so far, times ``factor``: 1 is exact, more skips more.

The index is a table: vectors are dealt evenly over shards of about ``SHARD_BYTES``,
each task builds the tree of its shard and writes it in the order of its leaves,
with the vantage points and radii of the nodes. Queries are a table as well, in
blocks of about ``QUERY_BLOCK`` rows that are sent to every shard of their length by
its number. A task reads one tree and one block at a time from the shuffle, so the
driver sees counts only, memory is bounded by a shard and a block, and the number
of pairs of those, not their size, grows with the input. The k best of each pair are
merged in two steps. Equal vectors are one point of a tree with its smallest ids,
however many copies there are. Where the last place is tied beyond the spare points,
all points of the shard at that product are ranked.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; only vectors of one length are compared; rows that
repeat a vec_id are one candidate and one query (the row that sorts first);
null ids take no part; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow import map_batches
from touchline.llm.staging import Stage

K, EVERY, FACTOR = 20, 20, 1.0
SHARD_BYTES, LEAF, QUERY_BLOCK = 8 << 20, 128, 16_384
SPARE = 12  # more points than k, so that rounding can't cost one
FIRST_MERGES = 32


def layout(n: int) -> list[tuple[int, int, int, int]]:
    """(from, to, inner, outer) of the nodes of a tree of ``n`` rows; inner is -1 for a leaf."""
    nodes: list[tuple[int, int, int, int]] = [(0, n, -1, -1)]
    todo = [0]
    while todo:
        at = todo.pop()
        lo, hi, _, _ = nodes[at]
        if hi - lo > LEAF:
            mid = lo + (hi - lo) // 2
            nodes[at] = (lo, hi, len(nodes), len(nodes) + 1)
            todo += [len(nodes), len(nodes) + 1]
            nodes += [(lo, mid, -1, -1), (mid, hi, -1, -1)]
    return nodes


class Tree:
    """Vantage-point tree over the rows of ``x``; with ``vantage`` and ``radius`` of its nodes, ``x`` is in the order of the leaves already."""

    def __init__(self, x: np.ndarray, vantage: np.ndarray | None = None, radius: np.ndarray | None = None) -> None:
        norms = np.einsum("ij,ij->i", x, x)
        self.m2 = norms.max()
        lift = np.sqrt(np.maximum(self.m2 - norms, 0))
        self.order, nodes = np.arange(len(x)), layout(len(x))
        if vantage is None:
            vantage, radius = np.full(len(nodes), -1), np.zeros(len(nodes))
            for at, (lo, hi, inner, _) in enumerate(nodes):  # a node comes before those it is split into
                if inner >= 0:
                    own = self.order[lo:hi]
                    v = own[0]
                    d = np.sqrt(np.maximum(2 * (self.m2 - x[own] @ x[v] - lift[own] * lift[v]), 0))
                    by = np.argsort(d, kind="stable")
                    mid = (hi - lo) // 2
                    self.order[lo:hi] = own[by]
                    vantage[at], radius[at] = v, float(d[by[mid - 1]] + d[by[mid]]) / 2
            place = np.empty(len(x), np.int64)
            place[self.order] = np.arange(len(x))
            vantage = np.where(vantage >= 0, place[vantage], -1)
        self.vantage, self.radius = vantage, radius
        self.nodes = [(lo, hi, int(v), float(r), inner, outer) for (lo, hi, inner, outer), v, r in zip(nodes, vantage, radius)]
        self.sorted = x[self.order]

    def search(self, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and products of the ``k`` best for each query (-1 and -inf where there are fewer)."""
        n = len(q)
        rows, best = np.full((n, k), -1), np.full((n, k), -np.inf)
        scale = np.einsum("ij,ij->i", q, q) + self.m2
        done = np.full(n, -1)  # the leaf that the first descent has scored

        def score(lo: int, hi: int, some: np.ndarray) -> None:
            s = np.concatenate([best[some], q[some] @ self.sorted[lo:hi].T], axis=1)
            r = np.concatenate([rows[some], np.broadcast_to(self.order[lo:hi], (len(some), hi - lo))], axis=1)
            keep = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best[some], rows[some] = np.take_along_axis(s, keep, 1), np.take_along_axis(r, keep, 1)

        def far(some: np.ndarray, v: int) -> np.ndarray:
            return np.sqrt(np.maximum(scale[some] - 2 * (q[some] @ self.sorted[v]), 0))

        stack = [(0, np.arange(n))]
        while stack:  # each query down to its own leaf, for a first bound
            at, some = stack.pop()
            lo, hi, v, radius, inner, outer = self.nodes[at]
            if v < 0:
                score(lo, hi, some)
                done[some] = at
                continue
            near = far(some, v) <= radius
            stack += [(c, s) for c, s in ((inner, some[near]), (outer, some[~near])) if len(s)]
        stack = [(0, np.arange(n))]
        while stack:
            at, some = stack.pop()
            lo, hi, v, radius, inner, outer = self.nodes[at]
            if v < 0:
                some = some[done[some] != at]
                if len(some):
                    score(lo, hi, some)
                continue
            d = far(some, v)
            bound = np.sqrt(np.maximum(scale[some] - 2 * best[some].min(axis=1), 0)) + 1e-9  # infinite while fewer than k are known
            stack += [(c, s) for c, s in ((inner, some[factor * (d - radius) <= bound]), (outer, some[factor * (radius - d) <= bound])) if len(s)]
        return rows, best


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed in the same order wherever it is computed."""
    return np.add.reduce(q * x, axis=-1)


def usable(vec: str = "embedding"):
    v = F.col(vec).cast("array<double>")
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda e: e != 0), F.lit(False))


class _Shard:
    """Distinct vectors of one length with the smallest ids of each."""

    def __init__(self) -> None:
        self.ids: dict[bytes, list[int]] = {}

    def add(self, vec_id: int, vector: np.ndarray, k: int) -> None:
        own = self.ids.setdefault(vector.tobytes(), [])
        own.append(vec_id)
        if len(own) > 8 * k:
            own[:] = sorted(set(own))[: k + 1]  # no result holds more than k ids, and one may be the query's own

    def table(self, shard: int, k: int) -> pa.RecordBatch:
        """The rows of the index: vectors in the order of the leaves, and beside them the nodes of the tree."""
        x = np.stack([np.frombuffer(b, float) for b in self.ids])
        tree = Tree(x)
        names = [sorted(set(v))[: k + 1] for v in self.ids.values()]
        n, d, m = len(x), x.shape[1], len(tree.vantage)
        vantage, radius = np.full(n, -1), np.zeros(n)
        vantage[:m], radius[:m] = tree.vantage, tree.radius
        vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * d, tree.sorted.ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.full(n, d)), pa.array(np.arange(n)), pa.array([names[i] for i in tree.order], pa.list_(pa.int64())), vectors, pa.array(vantage), pa.array(radius)], _INDEX)


_INDEX = ["shard", "d", "at", "ids", "vector", "vantage", "radius"]
_INDEX_SCHEMA = "shard long, d long, at long, ids array<long>, vector array<double>, vantage long, radius double"


def search_shard(ids: list[int], q: np.ndarray, tree: Tree, names: list[list[int]], k: int, factor: float) -> list[list[tuple[float, int]]]:
    """The ``k`` best (minus product, id) of each query among the vectors of a tree, its own id left out."""
    x = tree.sorted
    rows, _ = tree.search(q, k + SPARE, factor)
    longest = np.sqrt(tree.m2)
    out = []
    for i in range(len(q)):
        own = rows[i][rows[i] >= 0]
        s = products(q[i][None], x[own])
        if len(own) == k + SPARE:
            last, slack = np.sort(s)[-k - 1], 1e-9 * longest * np.linalg.norm(q[i])  # one more than k: a point may be the query's own
            if last - s.min() <= slack:  # more points may tie with the last one than were kept
                own = np.flatnonzero(x @ q[i] >= last - slack)
                s = products(q[i][None], x[own])
        seen: dict[int, float] = {}
        for v, j in sorted({(-float(v), j) for v, r in zip(s, own.tolist()) for j in names[r] if j != ids[i]}):
            seen.setdefault(j, v)
            if len(seen) == k:
                break
        out.append([(v, j) for j, v in seen.items()])
    return out


def distinct_ids(table: DataFrame) -> DataFrame:
    """The usable vectors, of rows that repeat an id the one that sorts first."""
    usable_rows = table.filter(F.col("vec_id").isNotNull() & usable()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return usable_rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def build_index(table: DataFrame, stage: Stage, k: int = K) -> DataFrame:
    """The stored trees of all usable vectors of ``table``."""
    vectors = distinct_ids(table)
    size = vectors.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0] * 8

    def step(batches):
        shards: dict[int, _Shard] = {}
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.asarray(v.values, float)
                shards.setdefault(len(v), _Shard()).add(vec_id, v, k)
            d = max(shards, key=lambda d: d * len(shards[d].ids), default=0)
            if 8 * sum(d * len(s.ids) for d, s in shards.items()) >= 2 * SHARD_BYTES:
                yield shards.pop(d).table(base + n, k)
                n += 1
        for s in shards.values():
            yield s.table(base + n, k)
            n += 1

    return stage.write(map_batches(vectors.repartition(max(1, -(-size // SHARD_BYTES))), step, _INDEX_SCHEMA))


def nearest(table: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, stage: Stage | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest rows of ``table`` but its own."""
    stage = stage or Stage(table.sparkSession)
    index = build_index(table, stage, k)
    asked = stage.write(distinct_ids(queries).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.size("embedding").cast("long").alias("d")))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = index.groupBy("d").agg(F.collect_set("shard").alias("shards"))  # one number for every SHARD_BYTES of vectors
    none = {"at": F.lit(0).cast("long"), "vantage": F.lit(-1).cast("long"), "radius": F.lit(0.0)}
    sent = asked.join(shards, "d").select(F.explode("shards").alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), F.array("id").alias("ids"), "vector").withColumns(none)
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    names = ["shard", "block", "kind", "at", "ids", "vector", "vantage", "radius"]
    dealt = trees.select(*names).unionByName(sent.select(*names)).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "at")

    def step(batches):
        now, held = None, ([], [])

        def done():
            trees, asked = (pa.Table.from_batches(h) if h else None for h in held)
            if not trees or not asked:
                return
            x, q = (t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (trees, asked))
            m = len(layout(len(x)))
            tree = Tree(x, *(trees.column(c).to_numpy()[:m] for c in ("vantage", "radius")))
            ids = asked.column("ids").combine_chunks().flatten().to_pylist()
            best = search_shard(ids, q, tree, trees.column("ids").to_pylist(), k, factor)
            some = [i for i, b in enumerate(best) if b]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in some], pa.int64()), pa.array([now[0] % FIRST_MERGES] * len(some), pa.int32()), pa.array([[{"s": s, "vec_id": j} for s, j in best[i]] for i in some], pa.list_(pa.struct([("s", pa.float64()), ("vec_id", pa.int64())])))],
                ["query_id", "part", "best"],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if keys[lo][:2] != now:
                        yield from done()
                        now, held = keys[lo][:2], ([], [])
                    held[keys[lo][2]].append(batch.slice(lo, hi - lo))
        yield from done()

    found = map_batches(dealt, step, "query_id long, part int, best array<struct<s:double,vec_id:long>>")
    top = lambda c: F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list(c)))), 1, k).alias("best")
    merged = found.groupBy("query_id", "part").agg(top("best")).groupBy("query_id").agg(top("best"))
    out = merged.select("query_id", F.posexplode("best").alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
