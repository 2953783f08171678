import random
from hashlib import md5, sha256
from zlib import crc32

import duckdb
import pytest

from minuteworks.llm import prefix_trie as T
from minuteworks.llm.queries import OP13_SQL


def rebuilt(rows):
    """``rows``: (conv_id, turn, role, text) -> conv_id -> [(role, text)]."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: (t[:2], md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(conversations):
    """All nodes from a dictionary of all prefixes."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def locally(conversations, pieces, groups):
    """The trie by folds of sorted slices, contracted and merged in groups, without Spark."""
    groups_of = {}
    for c, turns in conversations.items():
        groups_of.setdefault(tuple(turns), []).append(c)
    rows = []
    for turns, ids in groups_of.items():
        key = b"".join(md5(repr(t).encode()).digest() for t in turns)
        rows.append(T.Row(key, [len(t[1]) for t in turns], {len(turns): [len(ids), min(ids), 0, 0, 0, None]}, False))
    rows.sort(key=lambda r: r.key)
    nodes, parts = [], []
    cuts = sorted({0, len(rows), *pieces})
    kept = []
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if k % 2 == 0:  # every second slice goes on with what the one before left
            parts += kept
            kept = []
        kept = T.fold(kept + rows[a:z], nodes)
    parts += kept
    while len(parts) > groups:
        parts = [r for k in range(0, len(parts), groups) for r in T.fold(parts[k : k + groups], nodes)]
    T.fold(parts, nodes, final=True)
    found = {n[9]: n[0] for n in nodes if n[9]}
    return sorted(((n[0], n[1], n[2] if n[3] is None else found[n[3]], *n[4:8]) for n in nodes), key=str)


def test_folds_of_any_slices():
    rng = random.Random(4)
    for trial in range(400):
        alphabet = [("r", "x" * n) for n in range(rng.randint(1, 4))]
        conversations = {c: [rng.choice(alphabet) for _ in range(rng.randint(0, 6))] for c in range(rng.randint(1, 30))}
        pieces = [rng.randint(0, 30) for _ in range(rng.randint(0, 8))]
        pieces = [p for p in pieces if p < len({tuple(t) for t in conversations.values()})]
        assert locally(conversations, pieces, rng.choice([3, 4, 8])) == sorted((r[:7] for r in plain(conversations)), key=str)


CASES = [
    *[(100, t, "user", f"turn {t}") for t in range(7)],
    *[(100 + k, t, "user", f"turn {t}") for k in range(1, 60) for t in range(k % 9)],  # copies and prefixes
    *[(k, t, "user", "hello") for k in range(200, 260) for t in range(4)],  # one group of copies
    *[(301, t, None, None) for t in range(3)], *[(301, 3, "", "")], *[(302, t, "", "") for t in range(4)],  # no base; nulls are empty
    (400, None, "user", "first"), (400, 0, "user", "second"), (400, -1, "user", "middle"), (400, 0, "user", "tie"), (400, 0, "user", "tie"),
    (401, 0, "user", "x" * 100_000), (402, 0, "us", "erx"), (403, 0, "u", "serx"), (404, 0, "user", "é😀"),
    *[(405, t, "user", f"long {t}") for t in range(300)],
    (-5, 0, "user", "negative"), (-5, 1, "user", "negative"), (None, 0, "user", "nobody's"), (None, None, None, None),
]


def test_cases(spark):
    rows = [(*r, b"k", [1], "x") for r in CASES]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key binary, sizes array<int>, base string").repartition(5)
    want = rebuilt([(c if c is None or c >= 0 else c, *r) for c, *r in CASES])
    want[-5] = ([] if 0 not in want else want[0]) + [("user", "negative")] * 2 if crc32(b"-5") % 6 == 0 else [("user", "negative")] * max(0, 2 - crc32(b"-5") % 6)
    got = rows_of(T.conversation_trie(frame))
    assert len(got) == len({(r[0], r[1]) for r in got})
    assert got == plain(want)
    assert T.conversation_trie(frame.limit(0)).count() == 0
    assert T.conversation_trie(frame.where("conv_id is null")).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    ids = [c for c in range(700, 800) if crc32(str(c).encode()) % 6 >= 2 and c != 700][:3]
    frame = spark.createDataFrame([(c, 0, "user", "gone") for c in ids], "conv_id long, turn long, role string, text string")
    (row,) = T.conversation_trie(frame).collect()
    assert tuple(row) == (ids[0], 0, None, 3, 0, 1, 0, sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_many_parts_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(T, "FOLDED", 3)
    rng = random.Random(9)
    conversations = {c: [("r", "x" * rng.randint(0, 2)) for _ in range(rng.randint(0, 9))] for c in range(800)}
    hashed = lambda t: md5(repr(t).encode()).digest()
    rows = [(c, bytearray(b"".join(map(hashed, turns))), [len(t[1]) for t in turns]) for c, turns in conversations.items()]
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(T.prefix_trie(spark.createDataFrame(rows, "conv_id long, key binary, sizes array<int>")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(conversations)


@pytest.mark.parametrize("size", ["", "sf0.01"])
def test_whole_table_against_brute_force_and_sql(spark, sf_dir, size):
    path = f"{sf_dir.rsplit('/', 1)[0]}/{size}" if size else sf_dir
    conversations = spark.read.parquet(f"{path}/conversations.parquet")
    want = plain(rebuilt([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]))
    frame = T.conversation_trie(conversations)
    assert rows_of(frame) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({OP13_SQL})").fetchall(), key=str) == want
