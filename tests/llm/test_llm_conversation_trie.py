"""Tries against sets of all prefixes in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from themeloom.llm import conversation_trie as ct
from themeloom.llm.common import Stages

SCHEMA = "conv_id long, turn long, role string, text string, a string, depth int"


def content(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), content(role, text), (role or "", text or "")))
    return {c: [t[2] for t in sorted(ts)] for c, ts in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    saving = {k: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k, m in members.items()}
    rows = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        rows.append(
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), sum(not children[x] for x in below),
             sum(saving[x] for x in below), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def some_rows(seed, convs=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 200), convs):
        for t in range(rng.randint(0, longest)):
            turn = rng.choice([t, t, t, t, None, 0])
            rows.append((c, turn, rng.choice(["user", "user", "bot", None]), rng.choice(["hi", "a b", " x y\tz ", "", None]), "mine", 7))
    return rows


def nodes_of(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"piece": 2, "slice_turns": 5}), (3, {"piece": 3, "slice_turns": 1})])
def test_equals_all_prefixes(spark, seed, options):
    rows = some_rows(seed)
    rows += [(1000, 5, "user", "again", "mine", 7)] * 12  # one row many times
    rows += [(2000 + i, t, "user", f"turn {t}", "mine", 7) for i in range(4) for t in range(7 + 10 * i)]  # long, one in the other
    rows += [(None, 1, "user", "nobody's", "mine", 7), (7000, None, None, None, "mine", 7), (7001, None, None, None, "mine", 7)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert nodes_of(ct.conversation_trie(frame, **options)) == brute(in_order(rows))


@pytest.mark.parametrize(("seed", "piece"), [(4, 2), (5, 4096)])
def test_rebuilt_conversations(spark, seed, piece):
    rows = some_rows(seed, 90) + [(20 * i, t, "user", f"base {t}", "mine", 7) for i in range(6) for t in range(i)]
    stages = Stages(spark)
    slim = stages.keep(ct.slim_turns(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    turns, order = ct.rebuilt_turns(slim, stages)
    convs = rebuild(in_order(rows))
    assert any(not ts for ts in convs.values())
    assert nodes_of(ct.prefix_trie(turns, slim.select("conv_id"), order, piece=piece)) == brute(convs)


def test_one_long_conversation_in_many_tasks(spark):
    rows = [(5, t, "user", f"w {t % 7}", "", 0) for t in range(3000)] + [(9, t, "user", f"w {t % 7}", "", 0) for t in range(1500)]
    got = ct.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), piece=64, slice_turns=100).collect()
    by_depth = {r.depth: r for r in got}
    assert len(got) == 3001 and all(r.conv_id == 5 and r.n_leaves == 1 for r in got)
    assert [by_depth[d].saved_tokens for d in (0, 1, 1000, 1500, 1501)] == [3000, 3000, 1002, 2, 0]
    assert [by_depth[d].n_convs for d in (1, 1500, 1501, 3000)] == [2, 2, 1, 1]
    assert by_depth[1500].ends_sha256 == hashlib.sha256(b"9").hexdigest()


def test_sequences_with_one_digest_start_again(spark):
    rows = [(1, 0, "u", "x", "", 0), (1, 1, "u", "y", "", 0), (2, 0, "u", "y", "", 0), (2, 1, "u", "x", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    # With base 1 a digest is a sum, so the order of turns does not count.
    assert nodes_of(ct.conversation_trie(frame, base=1)) == brute(in_order(rows))
    assert nodes_of(ct.conversation_trie(frame, base=1, slice_turns=1)) == brute(in_order(rows))


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.conversation_trie(none).collect() == []
    slim = ct.slim_turns(none)
    members = spark.createDataFrame([(3,), (4,), (3,), (None,)], "conv_id long")
    got = nodes_of(ct.prefix_trie(slim, members, ["turn", "content", "tie"]))
    assert got == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_and_perfect(count):
    rng = np.random.default_rng(count)
    a, b = rng.integers(0, 2**64, (2, count), dtype=np.uint64)
    slots = ct.Slots(a, b)
    assert sorted(slots.find(a, b).tolist()) == list(range(count))
    assert (slots.find(b, a + np.uint64(1)) == -1).all()


def test_many_ids_of_one_node(spark):
    ends = spark.range(200_000).selectExpr("if(id % 3 = 0, 7, id) AS a", "1L AS b", "id * 5 - 9 AS conv_id")
    got = {r.a: r.ends_sha256 for r in ct.hashed_ids(ends).where("a < 100").collect()}
    wanted = defaultdict(list)
    for i in range(200_000):
        wanted[7 if i % 3 == 0 else i].append(i * 5 - 9)
    assert all(got[a] == hashlib.sha256(",".join(map(str, wanted[a])).encode()).hexdigest() for a in got) and 7 in got
