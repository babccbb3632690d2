"""Conversation operators against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from gleanery.llm import prefix_trie, turn_repair
from tests.conftest import values

SCHEMA = "conv_id long, turn long, role string, text string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256"]


def crc(text):
    return zlib.crc32(text.encode())


def by_conversation(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in found.items()}


def brute_trie(rows):
    own = by_conversation(rows)
    members = defaultdict(set)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = crc(str(c)) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        ends[whole].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []
    for path in members:
        below, leaves, saved = [path], 0, 0
        while below:
            x = below.pop()
            below += kids[x]
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * len(x[-1][1]) if x else 0
        text = ",".join(map(str, sorted(ends[path])))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None,
                    len(members[path]), len(kids[path]), leaves, saved,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, n=400):
    """Conversations that share beginnings, with nulls, ties, empty texts and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(0, n):
        if rng.random() < 0.1 or c == 200:
            continue
        for turn in range(rng.randrange(1, 7)):
            text = rng.choice(["a", "é😀", "", None, f"t{turn}", "long " * 20])
            row = (c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]),
                   text)
            rows += [row] * rng.choice([1, 1, 1, 1, 2])
    rows += [(None, 0, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**6), (2, 3)])
def test_trie_against_brute_force(spark, seed, hot_rows):
    rows = chats(seed)
    # A clashing name and an extra column; the operator reads its four alone.
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, c string, depth int")
    got = prefix_trie.prefix_trie(df, hot_rows=hot_rows)
    assert values(got, *TRIE) == brute_trie(rows)


def test_trie_of_many_equal_conversations(spark):
    rows = [(c, t, "user", "same" * t) for c in range(3000) for t in range(2)]
    rows += [(c, t, "user", f"long {t}") for c in (5000, 5001) for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert values(prefix_trie.prefix_trie(df), *TRIE) == brute_trie(rows)


def test_trie_of_one_turnless_conversation_and_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).collect() == []
    # 102 starts from conversation 100, which is absent, and skips its only turn.
    c = next(c for c in range(101, 200) if crc(str(c)) % 6 >= 1)
    lone = spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)
    assert values(prefix_trie.prefix_trie(lone), *TRIE) == brute_trie([(c, 0, "user", "x")])
    assert prefix_trie.prefix_trie(lone).head()["depth"] == 0


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
          "repaired_sha256"]
SPACE = " \t\n\v\f\r"


def brute_damage(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        found[c]
        place = ":".join(" " if x is None else str(x) for x in (c, turn))
        kind = crc(place) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        found[c] += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(turns) for c, turns in found.items()}


def cheapest(turns, must, cut):
    """Dijkstra's search over (cost, audit); roles are the initials written so far."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        tail = (i, roles[-1:] if roles else "", len(roles) == 1)
        if (tail, roles[:1] == "s" and len(roles) == 1) in seen:
            continue
        seen.add((tail, roles[:1] == "s" and len(roles) == 1))

        def push(more, edit, j, role=None, text=""):
            grown = roles + role[:1] if role is not None else roles
            if role is not None and (not role or not re.fullmatch("s|s?(ua)*u?", grown)):
                return
            line = () if role is None else (f"{role}:{text}",)
            heapq.heappush(heap, (cost + more, audit + edit, j, grown, lines + line))

        for role in ("user", "assistant"):
            push(2, "I", i, role)
        if i < len(turns):
            *_, role, text = turns[i]
            push(3, "D", i + 1)
            if not must[i]:
                push(cut[i], "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    push(2 + cut[i], "R", i + 1, other, text)


def brute_repair(rows):
    out = []
    for c, turns in brute_damage(rows).items():
        blank = [not t.strip(SPACE) for *_, t in turns]
        same = [(r, t) in [x[2:] for x in turns[:i]] for i, (*_, r, t) in enumerate(turns)]
        double = [s and not b for s, b in zip(same, blank)]
        must = [b or d for b, d in zip(blank, double)]
        cut = [not m and t.strip(SPACE)[-1] not in ".!?" for m, (*_, t) in zip(must, turns)]
        known = {t for has, t, *_ in turns if has}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, lines = cheapest(turns, must, cut)
        out.append((c, gaps, sum(blank), sum(double), sum(cut),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def dialogues(seed, n=300):
    rng, rows = random.Random(seed), []
    for c in range(-3, n):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] if turn else ["system", "user", "Sir", "s"])
            if rng.random() < 0.15:
                role = rng.choice(["", None, "system", "u", "tool", "user"])
            text = rng.choice(["Yes.", "no", " \t", None, "Really?! \n", "…", f"t{turn}.", "a.\x0bb"])
            place = turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.9 else None
            rows.append((c, place, role, text))
    rows += rows[:20] + [(None, 1, "user", "x."), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,segment,hot_rows", [(1, turn_repair.SEGMENT, 10**6), (2, 2, 4)])
def test_repair_against_search(spark, seed, segment, hot_rows):
    rows = dialogues(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, start int, k string")
    got = turn_repair.repair(df, segment=segment, hot_rows=hot_rows)
    assert values(got, *REPAIR) == brute_repair(rows)


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(6)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!"]))
            for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert turn_repair.segments(
        turn_repair.placed(turn_repair.damaged(df), 100), 30).count() > 20
    for segment, hot_rows in [(30, 100), (10**6, 10**6)]:
        got = turn_repair.repair(df, segment=segment, hot_rows=hot_rows)
        assert values(got, *REPAIR) == brute_repair(rows)


def test_repair_of_nothing_and_of_rows_that_are_all_dropped(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    turn = next(t for t in range(99) if crc(f"1:{t}") % 20 == 0)
    rows = [(1, turn, "user", "gone")]
    got = turn_repair.repair(spark.createDataFrame(rows, SCHEMA))
    assert values(got, *REPAIR) == brute_repair(rows) == [
        (1, 0, 0, 0, 0, 0, 0, "", turn_repair.NOTHING)]


def test_matrices_and_checkpoints_agree_with_plain_vectors():
    rng = random.Random(9)
    for _ in range(300):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(1, 60)))
        vector = turn_repair.FINAL
        for code in reversed(codes):
            vector = turn_repair._before(turn_repair._row(code, vector))
        m = turn_repair.matrix(codes)
        final = turn_repair.FINAL
        assert [min(m[4 * s + e] + final[e] for e in range(4)) for s in range(4)] == list(vector)
        assert turn_repair.walk(codes, 0, final)[3] == vector[0]
