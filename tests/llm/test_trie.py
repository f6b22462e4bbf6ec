"""Conversation prefix trie against brute force, and the radix tree's node layouts."""

import hashlib
import random
import zlib

from contactlake.llm import prefix_trie as P
from contactlake.llm.q_trie import rebuilt
from contactlake.llm.radix_tree import Direct, Indexed, Sorted, Tree

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(convs):
    """Nodes from {conv: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    own = {k: (len(m) - 1) * (len(k[-1][1]) if k else 0) for k, m in members.items()}
    leaves = {k: int(k not in children) for k in members}
    for key in sorted(members, key=len, reverse=True):
        if key:
            own[key[:-1]] += own[key]
            leaves[key[:-1]] += leaves[key]
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(key)))
        parent = min(members[key[:-1]]) if key else None
        out.append((len(key), min(m), parent, len(m), len(children.get(key, [])), leaves[key], own[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    """{conv: turns} in the operator's order."""
    tid = lambda r: hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, tid(r))):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return convs


def nodes(df):
    columns = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "", "é😀", "long text " * 20]
    rows = []
    for c in range(n):
        conv = c if c % 3 else c * 100
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            rows.append((conv, t, rng.choice(["user", "assistant"]), rng.choice(words[:2] if t < 3 else words), "own"))
    same = [(10_000 + i, t, "user", f"same {t}", "own") for i in range(40) for t in range(4)]
    return rows + same


def test_trie_equals_brute_force(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    turns = P.number_turns(df)
    want = brute(ordered(rows))
    assert nodes(P.trie(turns, turns)) == want
    # Short segments and small trees give the same nodes.
    assert nodes(P.trie(turns, turns, segment=2, keys=3)) == want


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c % 7} {t}", "own") for c in [0, 100, 101, 102, 199, 250, 300, 305, 401] for t in range(c % 4 + 1)]
    convs = ordered(rows)
    want = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    turns, names = rebuilt(P.number_turns(spark.createDataFrame(rows, SCHEMA)))
    assert any(not t for t in want.values())
    assert nodes(P.trie(turns, names)) == brute(want)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, "own"), (1, None, None, None, "own"), (1, 3, "user", "x" * 100_000, "own"), (1, 3, "user", "tie", "own"), (None, 1, "user", "lost", "own"),
        (2, 1, "", "", "own"), (2, 2, "us", "erx", "own"), (3, 1, "", "", "own"), (3, 2, "user", "x", "own"), (-5, 0, "user", "below", "own"),
    ]
    turns = P.number_turns(spark.createDataFrame(rows, SCHEMA))
    assert nodes(P.trie(turns, turns)) == brute(ordered(rows))
    empty = P.number_turns(spark.createDataFrame([], SCHEMA))
    assert P.trie(empty, empty).collect() == []


def test_node_layouts_grow():
    rng = random.Random(9)
    for fan, kind in ((3, Sorted), (12, Sorted), (30, Indexed), (200, Direct)):
        tree, keys = Tree(), {}
        firsts = rng.sample(range(256), fan)
        for i, byte in enumerate(firsts * 2):
            key = bytes([byte]) + bytes(rng.randrange(3) for _ in range(rng.choice([3, 7])))
            tree.insert(key, i, True)
            keys.setdefault(key, []).append(i)
        assert isinstance(tree.root.kids, kind)
        found = {key: list(node.ends) for key, node, ends in tree.aligned(4) if ends and key}
        assert {k: v for k, v in found.items() if v} == keys
        sizes = {key: node.size for key, node, _ in tree.aligned(4) if key}
        assert sizes == {p: sum(len(o) for k, o in keys.items() if k[: len(p)] == p) for p in {k[:n] for k in keys for n in (4, 8) if len(k) >= n}}
        assert [k for k, _, _ in tree.aligned(4)].count(b"") == 1
