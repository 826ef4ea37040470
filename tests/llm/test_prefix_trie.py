import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzfolio.llm import prefix_trie as pt
from quartzfolio.llm.common import table

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def by_hand(rows):
    own = {}
    for c, *turn in rows:
        if c is not None:
            own.setdefault(c, []).append(turn)
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        own[c] = [(r or "", t or "") for _, r, t in turns]
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(node, [])]
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        totals[node] = (sum(x[0] for x in below) if below else 1, own_saved + sum(x[1] for x in below))
        ends = sorted(c for c in members[node] if len(rebuilt[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children.get(node, [])), *totals[node], sha))
    return sorted(out, key=str)


def ours(frame):
    got = pt.trie(frame).collect()
    assert sorted(r["position"] for r in got) == list(range(1, len(got) + 1))
    return sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str), got


def test_whole_table(spark, sf_dir):
    frame = table(spark, sf_dir, "conversations")
    rows, got = ours(frame)
    assert rows == by_hand([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.collect()])
    for r in got:  # intervals are nested, and hold as many nodes as the subtree has
        assert r["position"] <= r["end"]
        assert (r["position"] == r["end"]) == (r["n_children"] == 0)


@pytest.mark.parametrize("copies", [1, 300])
def test_odd_rows(spark, copies, monkeypatch):
    monkeypatch.setattr(pt, "RUN", 7)
    rows = [(1, None, "user", "null turn first"), (1, 0, None, None), (1, 0, "", ""), (1, 3, "a", "1:b"), (-7, 1, "user", "neg"), (-5, 1, "user", "é漢"), (-5, 2, "user", "x"), (None, 1, "user", "nobody")]
    rows += [(10 + i, k, "user", "same" * (k + 1)) for i in range(copies) for k in range(12)]
    rows += [(2000, k, "r", f"deep {k}") for k in range(400)] + [(2001, k, "r", f"deep {k}") for k in range(200)] + [(3000, 0, "u", "x" * 100_000)] * 3
    frame = spark.createDataFrame([(*r, "u") for r in rows], DDL + ", depth string").repartition(5)
    assert ours(frame)[0] == by_hand(rows)


def test_empty(spark):
    assert pt.trie(spark.createDataFrame([], DDL)).count() == 0
    only = spark.createDataFrame([(4, 0, "u", "short")], DDL)  # h is over its turns: left without any
    assert zlib.crc32(b"4") % 9 > 0
    assert [tuple(r) for r in pt.trie(only).select("conv_id", "depth", "n_leaves").collect()] == [(4, 0, 1)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 12), st.integers(0, 4), st.sampled_from(["u", "a"]), st.sampled_from(["", "x", "y"])), min_size=1, max_size=60))
def test_any_rows(spark, rows):
    assert ours(spark.createDataFrame(rows, DDL))[0] == by_hand(rows)
