"""Operator 8: exact removal of repeated passages with a compressed FM-index per shard.

A window is ``WIDTH`` consecutive words of one document; each word covered by a
window whose words also start somewhere else is removed.

* Every window has an anchor, the least hash among its runs of ``GRAM`` words.
  Equal windows have equal anchors, so a window can only repeat if its anchor does.
  Anchors are counted over the whole corpus (combined before the shuffle) and
  those that occur once drop out.
* Consecutive windows with one anchor form a segment. Segments of equal anchor and
  hash form a class. Two members of a class go on (one that counts twice, where
  all are the same row), so copies of any number are two rows. Where the classes of
  neighbouring segments are the only ones of their anchors and have neighbouring
  members (a passage copied as it is), they go on together as one run.
* Segments are dealt by anchor, and runs by themselves, to tasks of about
  ``SHARD_WORDS`` words, which build one FM-index per shard. One member of each
  class is streamed through backward search over its wavelet tree, and the ranges
  of windows that match at least twice are reported for the class. So every
  removal rests on a match of words.
* Anchors with very many words (a passage in ever new surroundings, or periodic
  text) would put an unbounded group into one index. They are split by a second
  key: each of their windows is hashed whole, windows whose hash occurs once can't
  repeat and drop out, and two of the others go to the index of their own hash.
* The ranges go back to the documents, which are rewritten in one pass.

Hashes only decide what meets in an index, and that members of a class (64 bits of
anchor and 64 of words) share the verdict on it. Memory is bounded by a shard and a
batch of texts; only counted, small tables are broadcast. Intermediate tables are in
the shared checkpoint folder.

Defined results: null, empty and blank texts have no words; texts of fewer than
``WIDTH`` words lose nothing; words are compared as they are; repeated rows
repeat each other's windows; a null doc_id stays null; an empty table gives an
empty result; other columns of ``docs`` are kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.arrow import columns, map_batches
from touchline.llm.fmindex import FMIndex, repeated_windows
from touchline.llm.shingles import gram_hashes, hash_words, mix, pieces, word_spans
from touchline.llm.staging import Stage

WIDTH, GRAM = 35, 18  # shorter grams would also be shared by common lines that no window can cover
SHARD_WORDS = 300_000
MAX_TASKS = 20_000  # of the search; beyond that a task builds several indexes one after another
HOT_WORDS = 600_000  # of the classes of one anchor, beyond which their windows are dealt by a second key
RUN_WINDOWS = 2_048  # longer runs are cut
SMALL_ROWS, SMALL_SPANS = 1_000_000, 4_000_000  # rows and integers that may be broadcast
_OTHER = np.uint64(0xD1B54A32D192ED03)
_BASE = np.uint64(0x9FB21C651E98DF25)
_BASE_BACK = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of each ``n`` consecutive ones."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments of all texts of a batch: text, anchor, hash of the words, first window, windows, and places of the anchor in it.

    ``bounds`` has the first word of each text and one more at the end; the first window counts from the start of its text."""
    none = np.zeros(0, np.int64)
    if len(words) < WIDTH:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams = gram_hashes(words, GRAM)
    anchor = least_of(grams, WIDTH - GRAM + 1)
    own = text[: len(anchor)]
    valid = own == text[WIDTH - 1 :]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    ends = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True)) + 1
    n, own, anchor = ends - first, own[first], anchor[first]
    power = np.full(len(words) + 1, _BASE, np.uint64)
    power[0] = 1
    back = np.full(len(words) + 1, _BASE_BACK, np.uint64)
    back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power)[:-1])])
    stop = ends + WIDTH - 1
    s = mix((sums[stop] - sums[first]) * np.cumprod(back)[first] + n.astype(np.uint64))
    # an anchor has several places in a segment only if its gram is repeated in the text
    mark = mix(grams + text[: len(grams)].astype(np.uint64) * _OTHER)
    ordered = np.sort(mark)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    places = np.ones(len(first), np.int64)
    for k in np.flatnonzero(np.isin(mix(anchor + own.astype(np.uint64) * _OTHER), again)).tolist():
        places[k] = np.count_nonzero(grams[first[k] : ends[k] + WIDTH - GRAM] == anchor[k])
    return own, anchor, s, first - bounds[own], n, places


def _rows(docs: DataFrame) -> DataFrame:
    """A key of two numbers for each row beside its text; equal rows share it."""
    return docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("r2"), "text")


def _texts(batches, column: int = 2):
    """(batch, data, word starts, word ends, first word of each text, word hashes) of bounded pieces."""
    for whole in batches:
        for batch in pieces(whole, column):
            data, starts, ends, bounds = word_spans(batch.column(column))
            yield batch, data, starts, ends, bounds, hash_words(data, starts, ends, False)


def _runs(docs: DataFrame) -> DataFrame:
    names = ["r1", "r2", "anchor", "s", "first", "n", "places"]

    def step(batches):
        for batch, _, _, _, bounds, words in _texts(batches):
            own, anchor, s, first, n, places = segments_of(words, bounds)
            keys = [np.array(c, np.int64)[own] for c in columns(batch, "r1", "r2")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, anchor.view(np.int64), s.view(np.int64), first, n, places)], names)

    return map_batches(_rows(docs), step, ", ".join(f"{n} long" for n in names))


def _bodies(chosen: DataFrame) -> DataFrame:
    """The words of the listed segments (``parts``: anchor, s, first, n, weight)."""

    def step(batches):
        for batch, data, starts, ends, bounds, _ in _texts(batches):
            raw, rows = data.tobytes(), []
            for a, parts in zip(bounds.tolist(), *columns(batch, "parts")):
                for p in parts:
                    lo = a + p["first"]
                    hi = lo + p["n"] + WIDTH - 1
                    rows.append((p["anchor"], p["s"], b" ".join(raw[x:y] for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())), p["weight"]))
            columns_ = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["anchor", "s", "body", "weight"])

    return map_batches(chosen.select("r1", "r2", "text", "parts"), step, "anchor long, s long, body binary, weight long")


def _windows(chosen: DataFrame) -> DataFrame:
    """128 bits of each window of the listed segments, with its place in text and segment and the weight of the segment."""
    names = ["anchor", "s", "at", "r1", "r2", "first", "w1", "w2", "weight"]

    def step(batches):
        for batch, _, _, _, bounds, words in _texts(batches):
            out = [[np.zeros(0, np.int64)] for _ in names]
            for a, r1, r2, parts in zip(bounds.tolist(), *columns(batch, "r1", "r2", "parts")):
                for p in parts:
                    part = words[a + p["first"] : a + p["first"] + p["n"] + WIDTH - 1]
                    w1, w2 = gram_hashes(part, WIDTH), gram_hashes(mix(part + _OTHER), WIDTH)
                    at = np.arange(p["n"])
                    for column, values in zip(out, (*(np.full(p["n"], x) for x in (p["anchor"], p["s"])), at, *(np.full(p["n"], x) for x in (r1, r2)), p["first"] + at, w1.view(np.int64), w2.view(np.int64), np.full(p["n"], p["weight"]))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return map_batches(chosen.select("r1", "r2", "text", "parts"), step, ", ".join(f"{n} long" for n in names))


def _search(bodies: DataFrame, tasks: int) -> DataFrame:
    """``anchor, s, spans``: for each class of segments the ranges of its repeated windows (from, to, from, to, ...), if any."""
    dealt = bodies.repartition(tasks, "anchor").sortWithinPartitions("anchor", "s")

    def shard(held):
        codes: dict[bytes, int] = {}
        lists = [[codes.setdefault(w, len(codes) + 1) for w in body.split(b" ")] for _, _, body, _ in held]
        asked = [k for k, h in enumerate(held) if not k or h[:2] != held[k - 1][:2]]
        again = {k for k, h in enumerate(held) if h[3] > 1}
        copied = np.array([k in again or (k + 1 < len(held) and held[k + 1][:2] == held[k][:2]) for k in asked], bool)
        starts = np.cumsum([0, *(len(x) + 1 for x in lists)])[:-1]
        text = np.array([c for x in (*lists, *(lists[k] for k in sorted(again))) for c in (*x, 0)], np.int64)
        windows = np.array([len(x) for x in lists]) - WIDTH + 1
        spans: list[list[int]] = [[] for _ in asked]
        for k, a, b in zip(*(x.tolist() for x in repeated_windows(FMIndex(text), text, starts[asked], windows[asked], WIDTH, copied))):
            spans[k] += [a, b]
        some = [k for k, x in enumerate(spans) if x]
        return pa.RecordBatch.from_arrays([*(pa.array([held[asked[k]][c] for k in some], pa.int64()) for c in (0, 1)), pa.array([spans[k] for k in some], pa.list_(pa.int64()))], ["anchor", "s", "spans"])

    def step(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*columns(batch, "anchor", "s", "body", "weight")):
                if size >= SHARD_WORDS and row[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[2].count(b" ") + 2
        if held:
            yield shard(held)

    return map_batches(dealt, step, "anchor long, s long, spans array<long>")


def _chosen(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """One text of the rows that have listed segments (anchor, s, r1, r2, first, n, weight), with those."""
    lists = parts.groupBy("r1", "r2").agg(F.collect_list(F.struct("anchor", "s", "first", "n", "weight")).alias("parts"))
    ids = parts.select("r1", "r2").distinct()
    rows = _rows(docs)
    if ids.count() <= SMALL_ROWS:  # texts without a listed segment stay where they are
        rows = rows.join(F.broadcast(ids), ["r1", "r2"], "left_semi")
    return rows.dropDuplicates(["r1", "r2"]).join(lists, ["r1", "r2"])


def _two_of(rows: DataFrame, key: list[str], *same: str) -> DataFrame:
    """Two members (r1, r2, first) of each class of ``rows``, or one of double weight where all members are the same row."""
    lo, hi, total = (f(x).alias(n) for f, x, n in ((F.min, F.struct("r1", "r2", "first"), "lo"), (F.max, F.struct("r1", "r2", "first"), "hi"), (F.sum, "weight", "total")))
    one = rows.groupBy(*key).agg(lo, hi, total, *[F.first(c).alias(c) for c in same])
    weight = F.when((F.col("lo") == F.col("hi")) & (F.col("total") > 1), 2).otherwise(1).cast("long")
    return one.select(*key, *same, "total", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("r"), weight.alias("weight")).select(*key, *same, "total", "r.*", "weight")


def _runs_of(alone: DataFrame, stage: Stage) -> DataFrame:
    """``run, check, members, rows`` of runs of neighbouring classes (anchor, s, n, lo, hi): a class follows another if both its members do."""
    pair = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("lo", "hi") for c in ("r1", "r2", "first")]
    flat = alone.select("anchor", "s", "n", F.when((F.col("lo") == F.col("hi")) & (F.col("total") > 1), 2).otherwise(1).alias("weight"), *pair)
    by = ["lo_r1", "lo_r2", "hi_r1", "hi_r2"]
    w = Window.partitionBy(*by).orderBy("lo_first", "hi_first")
    follows = (F.col("lo_first") == F.lag(F.col("lo_first") + F.col("n")).over(w)) & (F.col("hi_first") == F.lag(F.col("hi_first") + F.col("n")).over(w))
    numbered = flat.withColumn("__open", F.when(follows, 0).otherwise(1)).withColumn("__run", F.sum("__open").over(w))
    cut = numbered.withColumn("__cut", F.floor(F.sum("n").over(Window.partitionBy(*by, "__run").orderBy("lo_first", "hi_first")) / RUN_WINDOWS))
    member = F.struct((F.col("lo_first")).alias("at"), "anchor", "s", "n")
    runs = cut.groupBy(*by, "__run", "__cut").agg(F.min("lo_first").alias("lo_first"), F.min("hi_first").alias("hi_first"), F.sum("n").alias("n"), F.max("weight").alias("weight"), F.collect_list(member).alias("members"))
    row = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("r1", "r2", "first")])
    keys = [F.xxhash64(F.lit(k), *by, "lo_first", "hi_first").alias(n) for k, n in enumerate(("run", "check"))]
    members = F.transform("members", lambda m: F.named_struct(F.lit("at"), m["at"] - F.col("lo_first"), F.lit("anchor"), m["anchor"], F.lit("s"), m["s"], F.lit("n"), m["n"]))
    return stage.write(runs.select(*keys, "n", F.col("weight").cast("long").alias("weight"), members.alias("members"), F.array_distinct(F.array(row("lo"), row("hi"))).alias("rows")))


def _pairs(spans: str = "spans"):
    """(a, b) of a flat list of ranges."""
    return F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.named_struct(F.lit("a"), F.get(spans, i), F.lit("b"), F.get(spans, i + 1)))


def _found(docs: DataFrame, parts: DataFrame, stage: Stage) -> DataFrame:
    words = parts.agg(F.coalesce(F.sum(F.col("n") + WIDTH), F.lit(0))).first()[0]
    return stage.write(_search(_bodies(_chosen(docs, parts)), max(1, min(MAX_TASKS, -(-words // SHARD_WORDS)))))


def _repeated(docs: DataFrame, hits: DataFrame, stage: Stage) -> DataFrame:
    """``anchor, s, a, b``: the ranges of repeated windows of each class of segments."""
    lo, hi = (f(F.struct("r1", "r2", "first")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))
    classes = stage.write(hits.groupBy("anchor", "s").agg(lo, hi, F.count("*").alias("total"), F.first("n").alias("n")))
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("n") + WIDTH).alias("words"))
    classes = stage.write(classes.join(anchors, "anchor").withColumn("kind", F.when((F.col("k") == 1) & (F.col("total") > 1), 0).when(F.col("words") <= HOT_WORDS, 1).otherwise(2)))
    weight = F.when((F.col("lo") == F.col("hi")) & (F.col("total") > 1), 2).otherwise(1).cast("long")
    two = lambda kind: classes.filter(F.col("kind") == kind).select("anchor", "s", "n", weight.alias("weight"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("r")).select("anchor", "s", "r.*", "n", "weight")

    runs = _runs_of(classes.filter("kind = 0"), stage)
    whole = runs.select(F.col("run").alias("anchor"), F.col("check").alias("s"), "n", "weight", F.explode("rows").alias("r")).select("anchor", "s", "r.*", "n", "weight")
    found = _found(docs, two(1).unionByName(whole), stage)
    in_run = runs.join(found.select(F.col("anchor").alias("run"), F.col("s").alias("check"), "spans"), ["run", "check"]).select(F.explode("members").alias("m"), _pairs().alias("p"))
    cut = F.transform("p", lambda p: F.named_struct(F.lit("a"), F.greatest(F.lit(0).cast("long"), p["a"] - F.col("m.at")), F.lit("b"), F.least(F.col("m.n") - 1, p["b"] - F.col("m.at"))))
    own = F.filter(cut, lambda x: x["b"] >= x["a"])
    ranges = found.select("anchor", "s", F.explode(_pairs()).alias("p")).unionByName(in_run.select("m.anchor", "m.s", F.explode(own).alias("p"))).select("anchor", "s", "p.*")
    if classes.filter("kind = 2").isEmpty():
        return stage.write(ranges)

    windows = stage.write(_windows(_chosen(docs, two(2))))
    twice = stage.write(_two_of(windows, ["w1", "w2"]).filter("total > 1").select(F.col("w1").alias("anchor"), F.col("w2").alias("s"), "r1", "r2", "first", F.lit(1).cast("long").alias("n"), "weight"))
    same = _found(docs, twice, stage).select(F.col("anchor").alias("w1"), F.col("s").alias("w2"))
    return stage.write(ranges.unionByName(windows.join(same, ["w1", "w2"]).select("anchor", "s", F.col("at").alias("a"), F.col("at").alias("b")).distinct()))


def repeat_spans(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``r1, r2, spans``: for each row with repeats the word ranges (start, stop, start, stop, ...) to remove."""
    stage = stage or Stage(docs.sparkSession)
    runs = stage.write(_runs(docs))
    anchors = runs.groupBy("anchor").agg(F.sum("places").alias("places")).filter("places > 1").select("anchor")
    hits = stage.write(runs.drop("places").join(anchors, "anchor"))
    stage.free(runs)
    ranges = _repeated(docs, hits, stage)
    spans = hits.join(ranges, ["anchor", "s"]).select("r1", "r2", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + WIDTH).alias("b"))
    ordered = spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = stage.write(_joined(ordered))
    stage.keep(out)
    return out


def joined_ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranges with those that touch made one, as start, stop, start, stop, ..."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    fresh = np.append(True, a[1:] > reach[:-1])
    return np.stack([a[fresh], reach[np.append(fresh[1:], True)]], axis=1).ravel()


def _joined(ordered: DataFrame) -> DataFrame:
    """The ranges (a, b) of each row joined."""

    def step(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offsets = offsets - offsets[0]
            done = [joined_ranges(a[x:y], b[x:y]) for x, y in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.list_(pa.int64()))], ["r1", "r2", "spans"])

    return map_batches(ordered.select("r1", "r2", "spans"), step, "r1 long, r2 long, spans array<long>")


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``__spans`` of their rows."""
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    keyed = docs.withColumns({"__r1": F.xxhash64("doc_id", "text"), "__r2": F.coalesce("doc_id", F.lit(-(1 << 62)))})
    own = spans.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("spans").alias("__spans"))
    small = n <= SMALL_ROWS and size <= SMALL_SPANS
    return keyed.join(F.broadcast(own) if small else own.hint("merge"), ["__r1", "__r2"], "left").drop("__r1", "__r2")


def _kept(text: str | None, spans: list[int] | None) -> tuple[int, bytes, int]:
    words = (text or "").encode().split()
    if not spans:
        return len(words), b" ".join(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, spans[0::2], 1)
    np.add.at(edge, spans[1::2], -1)
    gone = np.cumsum(edge)[:-1] > 0
    return len(words), b" ".join(w for w, g in zip(words, gone.tolist()) if not g), int(gone.sum())


def removal_digests(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""

    def step(batches):
        for batch in batches:
            ids, texts, spans = columns(batch, "doc_id", "text", "__spans")
            done = [_kept(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[1]).hexdigest() for d in done], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    docs = docs.select("doc_id", "text")
    return map_batches(_with_spans(docs, repeat_spans(docs, stage)), step, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``docs`` with the kept words of the texts that lose some, joined by one blank; other texts and null ones stay as they are."""
    spans = repeat_spans(docs.select("doc_id", "text"), stage)
    at = docs.columns.index("text")

    def step(batches):
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [_kept(t, s)[1].decode() if s else t for t, s in zip(texts, found)]
            arrays = batch.columns[:-1]
            arrays[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    return map_batches(_with_spans(docs, spans), step, docs.schema)
