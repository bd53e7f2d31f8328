"""Operator 12: BPE encoding and decoding with an index of pair occurrences.

The distinct runs of letters, digits and symbols of a block of texts (the part
of a partition that is in memory, about ``BLOCK_BYTES``) are laid end to end as
symbols. An index maps each pair of neighbouring symbols that has a rank to all
its positions in the block. The active ranks are applied in ascending order,
each to all its positions at once, and only the lists of the pairs on either
side of a merge change. This is exact because every merge of a file builds on
tokens of earlier ones (checked when it is loaded), so that no merge makes a
pair of a lower rank. A run of a million letters costs no more than its share.

The tokenizer file is a local path given as a parameter; it is read for its
vocabulary, merges, added tokens and the way it splits text. ASCII and Latin-1
words are split on their bytes, block by block; splitting of words with other
characters (NFC, white space, lower case, runs) is left to the library. Decoding
joins the tokens of the ids with a blank, as a file without a decoder does.

Texts beyond a block are cut at white space, which always ends a token, and
hashed part by part, so memory is bounded by a block and the longest word. There
is no shuffle, and a retried task gives the same rows.

Defined results: a null text is the empty text, with no ids and the empty
decoding; a null doc_id stays null; repeated rows give repeated results; strings
of added tokens in a text become their ids, as in a freshly loaded tokenizer; an
empty table gives an empty result; other columns are ignored. A file of another
kind (other splitting, a decoder, a vocabulary without all bytes) is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.arrow import map_batches

BLOCK_BYTES = 12 << 20
GONE = -1  # the symbol of a position that a merge has taken in

_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CUT = re.compile(rb"[ \t-\r]")
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")  # what follows an apostrophe in a token of its own


def byte_forms() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def latin_classes() -> np.ndarray:
    """The class of each code point below 256."""
    out = np.full(256, _OTHER, np.uint8)
    for c in map(chr, range(256)):
        if c in " \t\n\v\f\r":
            out[ord(c)] = _BLANK
        elif ord(c) < 32 or 0x7F <= ord(c) <= 0xA0:
            out[ord(c)] = _ODD
        elif c.isalpha():
            out[ord(c)] = _LETTER
        elif c.isnumeric():
            out[ord(c)] = _DIGIT
    return out


_CLASSES = latin_classes()
_ASCII = np.where(np.arange(256) < 128, _CLASSES, _ODD).astype(np.uint8)


class Merges:
    """The ranks of a file: which pairs of ids merge, how early, and into what."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str) -> None:
        self.left, self.right = (np.array([vocabulary[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.into = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.width = max(vocabulary.values()) + 1
        keys = self.left * self.width + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        made = {c: k for k, c in enumerate(self.into.tolist())}
        first = np.array([made.get(i, -1) for i in range(self.width)])
        self.ascending = len(made) == len(merges) and bool(np.all(np.maximum(first[self.left], first[self.right]) < np.arange(len(merges))))
        self.inner, self.last = (np.array([vocabulary.get(c + end, GONE) for c in byte_forms()], np.int64) for end in ("", suffix))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 for pairs that do not merge."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs (large binary) one after another, and where each run begins and the last ends."""
        bounds = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset : runs.offset + len(runs) + 1]
        data = np.frombuffer(runs.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        symbols = np.append(self.inner[data], GONE)
        ends = bounds[1:]
        symbols[ends - 1] = self.last[data[ends - 1]]
        self.merge(symbols, ends)
        left = symbols[:-1] != GONE
        return symbols[:-1][left].astype(np.uint32), np.concatenate([[0], np.cumsum(left)])[bounds]

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        """Apply all ranks to ``symbols`` (and one GONE behind them) in place; no pair reaches over one of ``ends``."""
        n = len(symbols) - 1
        if not n:
            return
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # neighbours; n stands for none
        after[ends - 1] = n
        before[ends] = before[0] = n
        places: list[list[np.ndarray]] = [[] for _ in self.into]  # the index: positions of the pair of each rank

        def note(at: np.ndarray, ranks: np.ndarray) -> None:
            some = np.flatnonzero(ranks >= 0)
            if len(some) == 1:
                places[ranks[some[0]]].append(at[some])
            elif len(some):
                some = some[np.argsort(ranks[some], kind="stable")]
                at, ranks = at[some], ranks[some]
                edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for rank, own in zip(ranks[np.append(0, edges)].tolist(), np.split(at, edges) if len(edges) else [at]):
                    places[rank].append(own)

        at = np.flatnonzero(after[:-1] < n)
        note(at, self.ranks(symbols[at], symbols[after[at]]))
        for rank, (a, b, c) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.into.tolist())):
            own, places[rank] = places[rank], ()
            if not own:
                continue
            at = own[0] if len(own) == 1 else np.sort(np.concatenate(own))
            then = after[at]
            live = (symbols[at] == a) & (symbols[then] == b)  # else an earlier merge has taken one of them
            if not live.all():
                at, then = at[live], then[live]
                if not len(at):
                    continue
            if a == b and len(at) > 1:  # of pairs that overlap every second one, from the left
                opens = np.append(True, then[:-1] != at[1:])
                lead = np.flatnonzero(opens)
                second = (np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))) % 2 == 1
                at, then = at[~second], then[~second]
            follow, lead = after[then], before[at]
            symbols[at], symbols[then] = c, GONE
            after[at] = follow
            before[follow] = at
            right = follow < n
            left = lead < n
            left[1:] &= lead[1:] != at[:-1]  # pairs of two merges of this rank are noted as right ones
            at_r, at_l = at[right], lead[left]
            note(np.concatenate([at_r, at_l]), self.ranks(np.concatenate([symbols[at_r], symbols[at_l]]), np.concatenate([symbols[follow[right]], np.full(len(at_l), c)])))


def binary(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def sliced(values: pa.Array, at: np.ndarray) -> Iterator[memoryview]:
    """The bytes of the values between each two of ``at``, as they lie in memory."""
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset :][: len(values) + 1][at].tolist()
    data = memoryview(values.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(bounds, bounds[1:]))


class PairIndex:
    """Encoder and decoder of one tokenizer file; one per worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for the splitting of words that are not plain
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        model, steps = layout["model"], (layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = [t for t in layout.get("added_tokens", ()) if t["content"]]
        known = (
            model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and (layout.get("normalizer") or {}).get("normalizers") == _NORMAL
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and not steps[1].get("add_prefix_space", True)
            and not steps[1].get("use_regex", True)
            and layout.get("decoder") is None
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        )
        self.merges = Merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model.get("end_of_word_suffix") or "") if known else None
        if not known or not self.merges.ascending or min(self.merges.inner.min(), self.merges.last.min()) < 0:
            raise ValueError(f"{path} is not a byte-level BPE file with this splitting")
        self.byte_of = {c: b for b, c in enumerate(byte_forms())}
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else re.compile("((?!))")
        self.starts = sorted({t.encode()[:2] for t in self.special})
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([names.get(i, "").encode() + b" " for i in range(max(names) + 1)], pa.large_binary())

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of all ids, added ones too, with a blank between two."""
        return b"".join(self.tokens.take(pa.array(ids)).to_pylist())[:-1]

    def _odd_runs(self, word: str) -> list[bytes | int]:
        """The runs of a word as the library splits it, and the ids of added tokens."""
        out: list[bytes | int] = []
        for k, part in enumerate(self.at_special.split(word)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [bytes(map(self.byte_of.__getitem__, run)) for run, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def _split(self, text: np.ndarray) -> tuple[pa.Array, np.ndarray, list[tuple[int, list[bytes | int]]]]:
        """Of bytes that end with a blank: the runs of plain words, where they begin, and the begins and runs of the other words."""
        kind = _ASCII[text]
        lead = np.flatnonzero((text == 0xC2) | (text == 0xC3))
        tail = text[lead + 1]
        latin = _CLASSES[(text[lead] & 3) << 6 | (tail & 63)]
        kind[lead] = kind[lead + 1] = latin
        low = text + 32 * ((text >= 65) & (text <= 90)).astype(np.uint8)
        high = lead[(text[lead] == 0xC3) & (tail <= 0x9E) & (tail != 0x97)] + 1
        low[high] += 32
        inside = np.zeros(len(text), bool)  # bytes that continue a character
        inside[lead + 1] = True
        blank = kind == _BLANK
        odd = [np.flatnonzero(kind == _ODD), *(np.flatnonzero((text[:-1] == s[0]) & (text[1:] == s[1])) for s in self.starts)]
        odd = np.concatenate(odd)
        words = []
        if len(odd):
            gaps = np.flatnonzero(blank)
            k = np.unique(np.searchsorted(gaps, odd))
            begin, end = np.where(k > 0, gaps[k - 1] + 1, 0), gaps[k]
            raw, seen = text.tobytes(), {}
            for a, b in zip(begin.tolist(), end.tolist()):
                if (own := seen.get(word := raw[a:b])) is None:
                    own = seen[word] = self._odd_runs(word.decode(errors="replace"))
                words.append((a, own))
            cover = np.zeros(len(text) + 1, np.int8)
            cover[begin], cover[end] = 1, -1
            kind[np.cumsum(cover[:-1]) > 0] = _BLANK
            blank = kind == _BLANK
        opens = np.append(True, kind[1:] != kind[:-1]) | (kind == _DIGIT)
        opens &= ~(blank | inside)
        mark = np.flatnonzero(opens[:-2] & (low[:-2] == ord("'")) & (kind[1:-1] == _LETTER))
        size = np.where(np.isin(low[mark + 1], np.frombuffer(_SHORT, np.uint8)), 1, 0)
        for s in _LONG:
            size[(low[mark + 1] == s[0]) & (low[mark + 2] == s[1])] = 2
        mark, size = mark[size > 0], size[size > 0]
        opens[mark + 1] = False
        rest = mark + 1 + size
        opens[rest[kind[rest] == _LETTER]] = True
        keep = ~blank
        begin = np.flatnonzero(opens)
        upto = np.cumsum(keep)
        return binary(low[keep], np.append(upto[begin] - 1, upto[-1])), begin, words

    def encode(self, parts: list[bytes]) -> list[tuple[memoryview, memoryview]]:
        """For each text its ids as little-endian bytes and their tokens, a blank after each; all texts are one block."""
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        runs, begin, odd = self._split(np.frombuffer(b"\n".join([*parts, b""]), np.uint8))
        extra = [(a, k, r) for a, own in odd for k, r in enumerate(own) if not isinstance(r, int)]
        fixed = [(a, k, r) for a, own in odd for k, r in enumerate(own) if isinstance(r, int)]
        coded = (pa.concat_arrays([runs, pa.array([r for *_, r in extra], pa.large_binary())]) if extra else runs).dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, ends = self.merges.encode_runs(coded.dictionary)
        if odd:  # each added token counts as one more run; then all into the order of the text
            added = np.unique(np.array([r for *_, r in fixed], np.uint32))
            codes = np.concatenate([codes, len(coded.dictionary) + np.searchsorted(added, np.array([r for *_, r in fixed], np.uint32))])
            flat, ends = np.concatenate([flat, added]), np.concatenate([ends, ends[-1] + 1 + np.arange(len(added))])
            nth = np.concatenate([np.zeros(len(begin), np.int64), np.array([k for _, k, _ in (*extra, *fixed)], np.int64)])
            begin = np.concatenate([begin, np.array([a for a, *_ in (*extra, *fixed)], np.int64)])
            order = np.lexsort((nth, begin))
            begin, codes = begin[order], codes[order]
        tokens = self.tokens.take(pa.array(flat))
        spans = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][ends] if len(flat) else np.zeros(len(ends), np.int64)
        take = pa.array(codes)
        ids, texts = binary(flat.astype("<u4"), 4 * ends).take(take), binary(tokens.buffers()[2] or b"", spans).take(take)
        at = np.searchsorted(begin, bounds)
        return list(zip(sliced(ids, at), sliced(texts, at)))


@lru_cache(maxsize=2)
def pair_index(path: str) -> PairIndex:
    return PairIndex(path)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a block, cut at white space."""
    start = 0
    while len(text) - start > BLOCK_BYTES and (cut := _CUT.search(text, start + BLOCK_BYTES)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def encoded(batches: Iterator[pa.RecordBatch], own: PairIndex) -> Iterator[tuple[int | None, bool, memoryview, memoryview]]:
    """``doc_id, whether it is the text's last part, ids, tokens`` of all parts of all texts, in order; blocks of parts are encoded together."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            parts = list(parts_of(text.as_py() or b""))
            for k, part in enumerate(parts):
                held.append((doc_id, k + 1 == len(parts), part))
                size += len(part) + 1
                if size >= BLOCK_BYTES:
                    yield from ((i, last, *x) for (i, last, _), x in zip(held, own.encode([p for *_, p in held])))
                    held, size = [], 0
    if held:
        yield from ((i, last, *x) for (i, last, _), x in zip(held, own.encode([p for *_, p in held])))


def _rows(docs: DataFrame, path: str, schema: str, start, add, done) -> DataFrame:
    """One row a document, built from its parts; rows go on in batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def step(batches):
        rows, now = [], start()
        for doc_id, last, ids, tokens in encoded(batches, pair_index(path)):
            add(now, ids, tokens)
            if last:
                rows.append((doc_id, *done(now)))
                now = start()
                if len(rows) == 512:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, types[c.split()[1]]) for v, c in zip(zip(*rows), schema.split(", "))], names)

    return map_batches(docs.select("doc_id", "text"), step, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` of every document."""

    def add(now, ids, tokens):
        now[0].append(np.frombuffer(ids, "<u4"))
        now[1].append(bytes(tokens))

    def done(now):
        ids = np.concatenate(now[0])
        return ids.astype(np.int32), len(ids), b"".join(now[1])[:-1].decode()

    return _rows(docs, path, "doc_id long, ids array<int>, n_tokens long, decoded string", lambda: ([], []), add, done)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_documents``, but with digests in place of ids and text; a text of many parts is hashed part by part."""

    def add(now, ids, tokens):
        now["n"] += len(ids) // 4
        now["ids"].update(ids)
        if len(tokens):
            now["text"].update(now["blank"])
            now["text"].update(tokens[:-1])
            now["blank"] = b" "

    def done(now):
        return now["n"], now["ids"].hexdigest(), now["text"].hexdigest()

    return _rows(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: {"n": 0, "ids": hashlib.sha256(), "text": hashlib.sha256(), "blank": b""}, add, done)
