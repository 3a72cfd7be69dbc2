"""The conversations' trie against one made of nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from thermolith.llm import prefix_trie, queries
from thermolith.llm.shared import table

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).hexdigest()[:32]


def rebuild(rows, every=5, most=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest(role, text)), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        first = c - int(abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def by_hand(built):
    """``built``: (id, turns) pairs."""
    nodes = {}
    for c, turns in built:
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    below = {p: [] for p in nodes}
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    smallest = {p: min(c for c, _ in m) for p, m in nodes.items()}
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[q][0] for q in below[p]) or 1, saved + sum(sums[q][1] for q in below[p]))
    return sorted(
        (smallest[p], len(p), smallest[p[:-1]] if p else None, len(m), len(below[p]), *sums[p], hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest()) for p, m in nodes.items()
    )


def rows(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=lambda r: (r[:2], str(r)))


def frame(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_has_the_nodes_of_nested_dictionaries(spark, size):
    folder = f"/root/testdata/{size}"
    data = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows(queries.op13_prefix_trie(spark, folder)) == by_hand(rebuild(data).items())


@pytest.mark.parametrize("ranges, run_rows", [(1, 7), (3, 5), (17, 40), (60, 3)])
def test_nodes_over_many_ranges_and_runs(spark, monkeypatch, ranges, run_rows):
    """A third of all conversations are copies of one, many share first turns; ranges part copies and open paths."""
    monkeypatch.setattr(prefix_trie, "IDS_CHARS", 40)
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", run_rows)
    rng = random.Random(ranges)
    turn = lambda: (rng.choice("ua"), rng.choice(["", "é", "long " * 9, "b"]))
    hot = [turn() for _ in range(6)]
    built = {c: [*hot[: rng.randint(0, 6)], *(turn() for _ in range(rng.randint(0, 4)))] for c in range(-60, 140)} | {c: list(hot) for c in range(200, 300)}
    made = spark.createDataFrame([(c, [(i, digest(*t), len(t[1].encode())) for i, t in enumerate(ts)]) for c, ts in built.items()], "conv_id long, turns array<struct<turn:int,digest:string,bytes:int>>")
    assert rows(prefix_trie.trie(made.repartition(4), ranges=ranges)) == by_hand(built.items())


def test_merge_gives_sorted_rows_with_their_common_prefixes():
    rng = random.Random(3)
    for n_runs in (0, 1, 2, 5, 8, 13):
        runs, c = [], 0
        for _ in range(n_runs):
            run = []
            for _ in range(rng.randint(0, 40)):
                run.append((b"".join(bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 6))), c := c + 1))
            run.sort()
            runs.append([(k, i, [], prefix_trie.common(run[j - 1][0], k) if j else 0) for j, (k, i) in enumerate(run)])
        got = list(prefix_trie.merged(runs))
        want = sorted((k, i) for r in runs for k, i, *_ in r)
        assert [g[:2] for g in got] == want
        assert [g[3] for g in got] == [prefix_trie.common(a[0], b[0]) if i else 0 for i, (a, b) in enumerate(zip([(b"",), *want], want))]


def test_merge_does_not_look_at_shared_turns_again(monkeypatch):
    """Runs of a long common start: looked at once for each run and not for each row."""
    start = b"x" * 16 * 500
    runs = [sorted((start + bytes([i]) * 16, 100 * r + i) for i in range(50)) for r in range(8)]
    runs = [[(k, c, [], 500 if j else 0) for j, (k, c) in enumerate(r)] for r in runs]
    looked, plain = [], prefix_trie.common
    monkeypatch.setattr(prefix_trie, "common", lambda a, b, known=0: looked.append(plain(a, b, known) - known) or plain(a, b, known))
    assert len(list(prefix_trie.merged(runs))) == 400
    assert sum(looked) < 8 * 500 + 400


def test_odd_rows(spark):
    data = [
        (1, None, None, None), (1, 0, "u", "x" * 200_000), (1, 0, "u", "x" * 200_000), (1, 0, "a", "tie"), (2, 5, "u", ""), (None, 0, "u", "left out"), (5, 0, "u", "h"), (6, 0, "u", "h"), (6, 1, None, "é"),
        (7, 0, "u", "own"), (2**62, 1, "u", "far"), (-3, 0, "u", "below"),
    ]
    df = frame(spark, data).withColumns({c: F.lit(1) for c in ("key", "turns", "digest", "depth", "run")})
    assert rows(prefix_trie.rebuilt_trie(df)) == by_hand(rebuild(data).items())
    assert rows(prefix_trie.rebuilt_trie(df.where("false"))) == []
    nodes = prefix_trie.last_turns(prefix_trie.rebuilt_trie(df), df)
    assert {(r["conv_id"], r["depth"]): r["text"] for r in nodes.collect()}[(min(c for c, *_ in data if c), 0)] is None
    assert {r["text"] for r in nodes.where("depth > 0").collect()} <= {t or "" for *_, t in data}
