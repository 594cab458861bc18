"""The prefix trie of conversations against sets of prefixes, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from clinspan.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        of = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = own.get(of, [])[:h] + mine[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        words = lambda n: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", n[-1][1]) if w]) if n else 0
        ends = sorted(c for c in members if len(paths[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(n) == len(node) + 1 for n in below), len(childless), sum((len(nodes[n]) - 1) * words(n) for n in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def shapes():
    rng = random.Random(5)
    yield "random", [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "d e f"])) for c in range(-30, 60) for t in range(rng.randint(1, 5)) if rng.random() < 0.9]
    yield "copies", [(c, t, "user", f"turn {t} of all") for c in range(300) for t in range(6)] + [(c, 9, "user", f"end {c % 3}") for c in range(0, 300, 2)]
    yield "ties and nulls", [(1, None, "a", "x"), (1, None, "a", "x"), (1, 0, None, None), (1, 0, "b", "y"), (None, 0, "a", "x"), (2, 5, "a", "x"), (22, 5, "a", "x"), (40, 1, "q", "one"), (41, 1, "q", "two"), (41, 1, "q", "one")]
    yield "turnless", [(c, 0, "user", "only") for c in range(21, 40)]
    yield "a long one", [(7, t, "user", f"t{t}") for t in range(60)] + [(8, t, "user", f"t{t}") for t in range(3)]
    yield "one", [(5, 0, "user", "hello there")]
    yield "none", []


@pytest.mark.parametrize("name,rows", list(shapes()), ids=[n for n, _ in shapes()])
def test_against_sets_of_prefixes(spark, name, rows):
    df = spark.createDataFrame([(c, t, r, x, "own", 3) for c, t, r, x in rows], SCHEMA + ", depth string, words int")
    got = sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr)
    assert got == plain(rows)
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.sql(trie.SQL).fetchall(), key=repr) == got


def test_slices(spark, monkeypatch):
    """A conversation cut into many slices, and ends in many pieces, give what one slice gives."""
    rows = [(c, t, "user", f"t{t}") for c in (3, 4, 60) for t in range(40)] + [(c, 1, "user", "x") for c in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    monkeypatch.setattr(trie, "SLICE", 4)
    monkeypatch.setattr(trie, "IDS", 8)
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr) == want
