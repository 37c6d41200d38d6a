"""Repair and trie of conversations against brute force over edit strings and over prefixes."""

import hashlib
import heapq
import random
import zlib
from pathlib import Path

import pytest

from strandlake.llm import conversation_repair, prefix_trie
from strandlake.llm.conversation_repair import NEXT, WANTED, cheapest
from strandlake.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos string, n string, part string, up string, `a.b` string"


def brute(turns):
    """Least (cost, initials) by a search over all edits in order of cost, then of initials."""
    heap = [(0, "", 0, 0)]
    done = set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(turns) and state in (0, 3):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(heap, (cost + 3, audit + "I", at, WANTED[state][1]))
        if at < len(turns):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            kind, extra = turns[at].lower(), 3 * turns[at].isupper()
            if kind != "-":
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, WANTED[state][1]))
                if kind in NEXT[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, NEXT[state][kind]))


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        turns = "".join(rng.choice("suaxSUAX--uaua") for _ in range(rng.randrange(9)))
        assert cheapest(turns) == brute(turns), turns


def awkward_turns():
    rows = [(1, None, "user", "hello."), (1, 2, None, "what"), (1, 2, "assistant", None), (1, 5, "assistant", " \t"), (1, 5, "user", "hello."), (2, 0, "", ""), (3, 0, "system", "be kind."), (3, 1, "user", "x" * 200_000 + "!")]
    rows += [(3, 2, "assistant", "done.")] * 3 + [(None, 1, "user", "no id."), (None, None, "assistant", "none?"), (4, None, "Ünder", "é  東京"), (4, None, "user", "line\nbreak. \v")]
    rows += [(20 + k, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {k % 3}.") for k in range(25) for t in range(k % 6)] + [(-7, 0, "user", "below."), (-20, 0, "user", "base.")]
    return [(*r, "extra", "extra", "extra", "extra", "extra") for r in rows]


def repaired_by_hand(rows, every):
    """A row per conversation, worked out turn by turn."""
    out = {}
    for key in every:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = brute("".join(conversation_repair.code(r[2][:1], f in ("b", "d"), f == "t") for r, f in zip(mine, faults, strict=True)))
        at, state, said = 0, 0, []
        for edit in audit:
            if edit == "I":
                said.append({"u": "user", "a": "assistant"}[WANTED[state][0]] + ":")
                state = WANTED[state][1]
                continue
            if edit == "K":
                said.append(f"{mine[at][2]}:{mine[at][3]}")
                state = NEXT[state][mine[at][2][:1]]
            elif edit == "R":
                said.append({"u": "user", "a": "assistant"}[WANTED[state][0]] + ":" + mine[at][3])
                state = WANTED[state][1]
            at += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[key] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_of_awkward_turns(spark):
    rows = awkward_turns()
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damage(conversations), conversations).collect()}
    damaged = []
    for conv, turn, role, text in (r[:4] for r in rows):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == repaired_by_hand(damaged, {r[0] for r in rows})
    plain = conversation_repair.repair(conversations)
    assert {r[0]: tuple(r)[1:] for r in plain.collect()} == repaired_by_hand([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows], {r[0] for r in rows})
    assert conversation_repair.repair(conversations.limit(0), conversations.limit(0)).collect() == []


def trie_by_hand(rows):
    """(depth, path) -> node, from all prefixes of all rebuilt conversations."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    prefixes = {p[:d] for p in paths.values() for d in range(len(p) + 1)} | {()}
    out = []
    for p in prefixes:
        members = sorted(c for c, path in paths.items() if path[: len(p)] == p)
        parent = min((c for c, path in paths.items() if path[: len(p) - 1] == p[:-1]), default=None) if p else None
        below = [q for q in prefixes if q[: len(p)] == p]
        children = lambda q: [x for x in prefixes if len(x) == len(q) + 1 and x[: len(q)] == q]
        saved = sum((sum(path[: len(q)] == q for path in paths.values()) - 1) * len(q[-1][1].translate(str.maketrans("\t\n\v\f\r", "     ")).replace("  ", " ").split(" ")) if q and q[-1][1].strip() else 0 for q in below)
        ends = ",".join(str(c) for c in members if paths[c] == p)
        out.append((min(members, default=None), len(p), parent, len(members), len(children(p)), sum(not children(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1, 4, 50_000])
def test_trie_of_awkward_turns(spark, limit):
    """A limit of one turn cuts every group down to single turns."""
    rows = awkward_turns() + [(100 + k, t, "user", f"same {t} words") + ("e",) * 5 for k in range(30) for t in range(3 + (k == 7))]
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie.rebuilt_trie(conversations, limit).collect()), key=repr)
    assert got == trie_by_hand([r[:4] for r in rows])


def test_trie_of_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in prefix_trie.rebuilt_trie(nothing).collect()] == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_prefix_trie"])
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {k for c, k in kinds.items() if c not in ("audit", "repaired_sha256", "ends_sha256")} == {"bigint"}
