"""The trie of rebuilt conversations against a plain trie of tuples."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from touchline.llm import queries, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(role, text) for _, role, text in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) or 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return _ordered(out)


def _ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[1], r[0]))


def _rows(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(-12, 50), *(10**12 + i for i in range(7)), 1 << 40]:
        for k in range(rng.choice([0, 1, 2, 3, 9, 12, 90])):
            rows.append((c, rng.choice([k, k, None, 1]), rng.choice(["user", None, "a"]), rng.choice(["x", "yé", None, ""]) if k % 3 == 0 else "same"))
    return rows + [(None, 1, "u", "x"), (None, None, None, None)] + rows[:5]


def test_odd_conversations(spark):
    rows = _rows(3)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS label", "'x' AS depth", "2 AS n", "3 AS len")
    assert _ordered(turn_trie.trie(frame).collect()) == plain(rows)


def test_long_shared_beginnings_and_copies(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "PIECE", 16)  # sums and chains over many pieces
    rows = [(c, k, "u", f"w{k}") for c in (100, 105, 110, 115, 120) for k in range(150 if c != 110 else 90)]
    rows += [(115, 149, "u", "other"), (120, 160, "u", "tail"), (120, 161, "u", "tail")]
    assert _ordered(turn_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "t")], [(3, 1, "u", "t")], [(5, 1, "u", "t"), (5, 2, None, None)], [(7, 1, "a", "b"), (12, 1, "a", "b")]])
def test_few_rows(spark, rows):
    assert _ordered(turn_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_ends_of_one_node_in_many_pieces(spark):
    """Ids that lie apart are joined in pieces, and their digest is taken in order over the pieces."""
    ids = sorted({-(1 << 45) - 3, -70_000, -1, *range(0, 300_000, 1117), 1 << 50})
    ends = spark.createDataFrame([(1, 4, c) for c in ids] + [(2, 4, 7)], "label long, depth long, conv_id long").repartition(3)
    got = {(r.label, r.depth): r.ends_sha256 for r in turn_trie.ends_digest(ends).collect()}
    assert got == {(1, 4): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (2, 4): hashlib.sha256(b"7").hexdigest()}


def test_a_conversation_over_many_partitions_keeps_its_order(spark):
    rows = [(10, k, "u", f"w{k % 7}") for k in range(3000)] + [(11, k, "u", "x") for k in range(4)]
    assert _ordered(turn_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()) == plain(rows)


def test_sql(spark, tmp_path):
    rows = _rows(5)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
        found = db.execute(queries.ORACLES["op11_turn_trie"]).fetchall()
    assert _ordered(found) == plain(rows)
