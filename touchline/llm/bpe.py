"""Operator 10: byte-level BPE encoding and decoding with the tiktoken library.

The rank file is a local path given as a parameter. Long texts are cut at safe
boundaries before they are encoded: a white-space character that follows a
character that is not white space always starts a new match of the pattern (a
match is white space only, or one optional space before one class of
characters), so encoding the parts one by one gives the ids of the whole.
A run of ``RUN_CHARS`` white-space characters or more overflows the stack of the
library's regular expressions, so it is taken out of them where the pattern ends
in the usual way (``WHITE``): the run, without its last character if something
follows, is one match, and its bytes are encoded as such by the same ranks.
Decoding works on raw bytes, so ids that split a code point still round-trip.

Defined results: a null text is encoded as the empty text (no ids); runs of any
length of any character have the ids that the ranks give to the matches; a null
``doc_id`` stays null; repeated rows give repeated results; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.arrow import columns, map_batches

PART_CHARS = 1 << 16  # texts beyond this are encoded in parts of about this size

_SCHEMA = "doc_id long, ids array<int>, n_tokens long, decoded binary"
WHITE = r"|\s+(?!\S)|\s+"
RUN_CHARS = 50_000  # of white space in a row
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what the library's patterns call white space
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_RUN = re.compile(f"[{_SPACE}]{{{RUN_CHARS},}}")


@lru_cache(maxsize=4)
def load(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a text before white space that follows something else; parts hold at least ``size`` characters if such a place exists."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoding, text: str) -> list[int]:
    if len(text) <= PART_CHARS and len(text) < RUN_CHARS:
        return encoding.encode_ordinary(text)
    ids, start = [], 0
    for run in _RUN.finditer(text) if encoding._pat_str.endswith(WHITE) else ():
        for part in safe_parts(text[start : run.start()]):
            ids += encoding.encode_ordinary(part)
        start = run.end() - (run.end() < len(text))
        ids += encoding._encode_single_piece(text[run.start() : start])
    for part in safe_parts(text[start:]):
        ids += encoding.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded`` of every document; no shuffle."""

    def step(batches):
        encoding = load(rank_file, pattern)
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            ids = [encode(encoding, t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([encoding.decode_bytes(x) for x in ids], pa.binary())],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

    return map_batches(docs.select("doc_id", "text"), step, _SCHEMA)


def digest_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, but with digests in place of the ids and bytes, made in the same pass."""

    def step(batches):
        encoding = load(rank_file, pattern)
        for batch in batches:
            doc_ids, texts = columns(batch, "doc_id", "text")
            ids = [encode(encoding, t or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoding.decode_bytes(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
