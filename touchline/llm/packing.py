"""Operator 1: hierarchical multi-length packing.

Every document becomes its token ids and one end id. Documents are routed by
length to context-size tiers (512 up to 4096 tokens); what exceeds the longest
tier is cut into full windows first. Each tier opens windows of its own size
with its own documents, longest first, and fills their gaps from the shorter
tiers: the longest piece that fits, and when none fits one piece is cut to the
gap. So every window is full, and only the last window of a block, when the
block runs out of pieces, is split at powers of two instead of padded. Windows
of a tier are then dealt to step groups of equal token counts so that the
attention cost (sum of squared piece lengths) is even between the groups.

A task packs its own partition in blocks of ``BLOCK_TOKENS``, so there is no
shuffle and memory is bounded by the block whatever the input; a retried task
gives the same rows.

Word ids come from the tokenizers library, as a freshly loaded file gives them.
Where the file says that white space always ends a token, the ids of a text are
those of its words in order, and each distinct word is asked for once and
remembered. Words of plain Latin characters are split by the file's own pattern
and go to the library's model; all others, and those that hold the string of an
added token, go through the whole tokenizer.

Defined results: a null text is the empty text (only the end id); a null doc_id
stays null; repeated rows are packed each on its own; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from touchline.llm.arrow import columns, map_batches

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
MEMO_WORDS = 250_000

_PLAIN = re.compile(r"[\x21-\x7e¡-ÿ]*")
_SPACE_SAFE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class WordIds:
    """Ids of words, asked of the tokenizer once per distinct word and kept for later batches of the same worker.

    The way the file splits text is read from it: only a tokenizer that folds white space, lower-cases, and takes runs by one
    pattern in byte form may be asked word by word; any other gets whole texts. The strings of its added tokens (such as an end
    mark that stands in a text) are left to the tokenizer itself."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = [t for t in layout.get("added_tokens", ()) if t["content"]]
        self.by_word = (
            (layout.get("normalizer") or {}).get("normalizers") == _SPACE_SAFE
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and not steps[1].get("add_prefix_space", True)
            and not steps[1].get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added)
        )
        if self.by_word:
            self.runs_of = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.byte_form = {w: self.tokenizer.pre_tokenizer.pre_tokenize_str(w)[0][0] for w in map(chr, range(0xA1, 0x100))}
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation that ``known`` replaced

    def _run(self, run: str) -> list[int]:
        if not run.isascii():
            run = "".join(self.byte_form.get(c, c) for c in run)
        return [t.id for t in self.tokenizer.model.tokenize(run)]

    def _ids(self, word: str) -> bytes:
        if (v := self.before.get(word)) is not None:
            return v
        if not _PLAIN.fullmatch(word) or self.added.search(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        elif word.isalpha():
            ids = self._run(word.lower())
        else:
            ids = [i for run in self.runs_of(word.lower()) for i in self._run(run)]
        return array("I", ids).tobytes()

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for x in lists for i in x], np.uint32), np.cumsum([0, *map(len, lists)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by END_ID, and where each text begins and the last ends."""
        if not self.by_word:
            return self._whole(texts)
        words = pc.ascii_split_whitespace(texts)
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, distinct))
        for k in [k for k, v in enumerate(ids) if v is None]:
            ids[k] = self.known[distinct[k]] = self._ids(distinct[k])
        if len(self.known) > MEMO_WORDS:
            self.before, self.known = self.known, {}
        table = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(sizes) - sizes)[codes]
        flat = table[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[offsets]
        return np.insert(flat, bounds[1:], np.uint32(END_ID)), bounds + np.arange(len(bounds))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    return next(t for t in tiers if length <= t)


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Yield (size, pieces) for each window of a block; a piece is (document index, start, length).

    Every window but the last few is as long as its tier; those last ones are powers of two. Sizes add up to the lengths."""
    top = tiers[-1]
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # sorted (length, index, start)
    for i, n in enumerate(lengths):
        full = n // top if n > top else 0
        for k in range(full):
            yield top, [(i, k * top, top)]
        if n - full * top:
            pools[tier_of(n - full * top, tiers)].append((n - full * top, i, full * top))
    for pool in pools.values():
        pool.sort()
    for tier in reversed(tiers):
        below = [t for t in reversed(tiers) if t < tier]
        while pools[tier]:
            n, i, start = pools[tier].pop()
            window, gap = [(i, start, n)], tier - n
            while gap:
                found = None
                for t in [t for t in below if pools[t]] + [tier]:
                    k = bisect_right(pools[t], (gap, 1 << 62, 0)) - 1
                    if k >= 0:
                        found = pools[t].pop(k)
                        break
                if found is None:  # nothing fits whole: cut the shortest piece that is longer than the gap
                    t = next((t for t in [*reversed(below), tier] if pools[t]), None)
                    if t is None:
                        break
                    n, i, start = pools[t].pop(0)
                    found = (gap, i, start)
                    insort(pools[tier_of(n - gap, tiers)], (n - gap, i, start + gap))
                n, i, start = found
                window.append((i, start, n))
                gap -= n
            if not gap:
                yield tier, window
            else:
                yield from at_powers(window)


def at_powers(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Split an unfilled window into windows whose lengths are powers of two."""
    left = sum(n for *_, n in pieces)
    queue = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            i, start, n = queue.pop()
            use = min(n, gap)
            window.append((i, start, use))
            if use < n:
                queue.append((i, start + use, n - use))
            gap -= use
        yield size, window
        left -= size


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: groups hold windows of one size and about ``step_tokens`` tokens, dealt to and fro by cost."""
    groups, first = [0] * len(windows), 0
    for size in sorted({s for s, _ in windows}):
        own = sorted((k for k, (s, _) in enumerate(windows) if s == size), key=lambda k: -sum(n * n for *_, n in windows[k][1]))
        n = -(-len(own) * size // step_tokens)
        for place, k in enumerate(own):
            turn, at = divmod(place, n)
            groups[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack_documents(docs: DataFrame, tokenizer_file: str, with_ids: bool = True, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group (and ids)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]

    def step(batches):
        ids_of = word_ids(tokenizer_file)
        base, sequences, steps = TaskContext.get().partitionId() << 40, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal sequences, steps
            windows = list(pack_block([len(data) for _, data in held], tiers))
            groups = step_groups(windows, step_tokens)
            rows = [[] for _ in names]
            ids = []
            for (size, pieces), group in zip(windows, groups):
                offset = 0
                for i, start, n in pieces:
                    doc_id, data = held[i]
                    own = data[start : start + n]
                    for column, value in zip(rows, (doc_id, start, n, zlib.crc32(own), len(data), base + sequences, offset, size, base + steps + group)):
                        column.append(value)
                    if with_ids:
                        ids.append(own.astype(np.int32))
                    offset += n
                sequences += 1
            steps += 1 + max(groups, default=-1)
            arrays = [pa.array(c, pa.int64()) for c in rows]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        tokens = 0
        for batch in batches:
            (doc_ids,) = columns(batch, "doc_id")
            flat, bounds = ids_of.encode(pc.fill_null(batch.column(batch.schema.get_field_index("text")), ""))
            for doc_id, start, stop in zip(doc_ids, bounds.tolist(), bounds[1:].tolist()):
                held.append((doc_id, flat[start:stop]))
                tokens += stop - start
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return map_batches(docs.select("doc_id", "text"), step, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids)
