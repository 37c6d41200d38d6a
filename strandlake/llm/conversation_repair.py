"""Repair of the turn structure of conversations: the cheapest edits that give well-formed turns.

Well-formed role initials are ``(s?(ua)+)?``. A finite automaton with four states reads them: nothing yet, after ``s``, after
``u``, after ``a``. A backward dynamic program over turn and state gives the least cost to go; a forward walk from the start
takes, among the edits that keep to that cost, the one whose initial is least in ASCII. Each initial leads to one state only
(an insertion or a new role is what the grammar wants next), so the walk gives the least string of initials.

Faults are found with windows. The program then runs over rows sorted by conversation: a row of one letter for each turn comes
before the texts, so a task keeps a byte a turn, the costs of every BLOCK-th turn, and no text but the one it hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns whose costs are worked out again at once in the forward walk.
BLOCK = 1024
#: States of the grammar; what each one reads next, and where that leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WANTED = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLE = {"u": "user", "a": "assistant"}
SPACES = r"\x20\x09-\x0D"
RESULT = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Costs = tuple[float, float, float, float]
END: Costs = (0, float("inf"), float("inf"), 0)


def with_insertions(c: list[float]) -> Costs:
    """Costs to go once insertions before the next turn are allowed; one round each way is enough, as more only add cost."""
    user, assistant = min(c[USER], INSERT + c[ASSISTANT]), min(c[ASSISTANT], INSERT + c[USER])
    return min(c[START], INSERT + user), min(c[SYSTEM], INSERT + user), user, assistant


def code(initial: str, must_go: bool, truncated: bool) -> str:
    """One letter for what the program has to know of a turn: s, u, a or x for its role, a capital if cut off, ``-`` if it must go."""
    kind = initial if initial in ("s", "u", "a") else "x"
    return "-" if must_go else kind.upper() if truncated else kind


def before(turn: str, after: Costs) -> Costs:
    """Costs to go before a turn, from those after it."""
    costs = [DELETE + c for c in after]
    if turn != "-":
        extra, kind = TRUNCATED * turn.isupper(), turn.lower()
        for state in range(4):
            reroled = REROLE + extra + after[WANTED[state][1]]
            kept = KEEP + extra + after[NEXT[state][kind]] if kind in NEXT[state] else reroled
            costs[state] = min(costs[state], reroled, kept)
    return with_insertions(costs)


def cheapest(turns: str) -> tuple[int, str]:
    """Least cost of codes ``turns``, and the ASCII-least initials of edits that reach it."""
    marks, costs = {}, with_insertions(list(END))
    marks[len(turns)] = costs
    for at in range(len(turns) - 1, -1, -1):
        costs = before(turns[at], costs)
        if at % BLOCK == 0:
            marks[at] = costs
    total, state, audit = costs[START], START, []
    for first in range(0, len(turns) or 1, BLOCK):
        last = min(first + BLOCK, len(turns))
        costs = {last: marks[last]}
        for at in range(last - 1, first, -1):
            costs[at] = before(turns[at], costs[at + 1])
        costs[first] = marks[first]
        at = first
        while at < last or at == len(turns):
            left, goal = costs[at][state], WANTED[state]
            turn = turns[at] if at < len(turns) else ""
            after = costs.get(at + 1)
            extra, kind = TRUNCATED * turn.isupper(), turn.lower()
            if turn and left == DELETE + after[state]:
                audit.append("D")
                at += 1
            elif left == INSERT + costs[at][goal[1]]:
                audit.append("I")
                state = goal[1]
            elif not turn:
                break
            elif kind in NEXT[state] and left == KEEP + extra + after[NEXT[state][kind]]:
                audit.append("K")
                state, at = NEXT[state][kind], at + 1
            else:
                audit.append("R")
                state, at = goal[1], at + 1
    return int(total), "".join(audit)


class _Conversation:
    """What is kept of the conversation a task is at."""

    def __init__(self, key: object):
        self.key, self.turns = key, []
        self.gaps = self.illegal = self.blank = self.duplicate = self.truncated = 0
        self.low = self.high = self.last_turn = self.last_role = None
        self.distinct, self.audit, self.cost, self.step, self.state = 0, None, 0, 0, START
        self.hash, self.empty = hashlib.sha256(), True

    def plan(self) -> None:
        self.cost, self.audit = cheapest("".join(self.turns))
        self.turns = []

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def insertions(self) -> None:
        while self.step < len(self.audit) and self.audit[self.step] == "I":
            initial, self.state = WANTED[self.state]
            self.say(ROLE[initial], "")
            self.step += 1

    def row(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if self.audit is None:
            self.plan()
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
            self.distinct += 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role
        self.blank, self.duplicate, self.truncated = self.blank + (fault == "b"), self.duplicate + (fault == "d"), self.truncated + (fault == "t")
        self.insertions()
        edit, self.step = self.audit[self.step], self.step + 1
        if edit == "K":
            self.state = NEXT[self.state][role[:1]]
            self.say(role, text)
        elif edit == "R":
            initial, self.state = WANTED[self.state]
            self.say(ROLE[initial], text)

    def end(self) -> tuple:
        if self.audit is None:
            self.plan()
        self.insertions()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if now is None or r["conv_id"] != now.key:
                done += [now.end()] if now else []
                now = _Conversation(r["conv_id"])
            if r["part"] == 1:
                now.turns.append(code(r["role"], r["fault"] in ("b", "d"), r["fault"] == "t"))
            elif r["part"] == 2:
                now.row(r["turn"], r["role"], r["text"], r["fault"])
        if done:
            yield _batch(done, batch.schema.field("conv_id").type)
    if now is not None:
        yield _batch([now.end()], batch.schema.field("conv_id").type)


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def fault() -> Column:
    """The first fault of a row by its columns text and ``nth`` (how often its role and text were there up to it): b, d, t or none."""
    visible = F.col("text").rlike(f"[^{SPACES}]")
    ends_well = F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    return F.when(~visible, "b").when(F.col("nth") > 1, "d").when(~ends_well, "t").otherwise("")


def repair(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role, text; ``every``, if given, has conv_id of conversations that are to be there even if no
    turn of them is left (zeros, an empty audit, the hash of nothing). Turns are ordered by turn, nulls first; ties by role, then
    text; a null role or text is one space, so such a text is blank and such a role has to be replaced. Rows without conv_id are
    one conversation. A wholly repeated row is a duplicate; empty texts are blank; texts are hashed whole, however long. An empty
    table gives an empty result. Other columns are not read.
    """
    space = F.lit(" ")
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    numbered = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    seen = numbered.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos"))).withColumn("fault", fault()).drop("nth")
    key = dict(turns.dtypes)["conv_id"]
    with Scratch(turns.sparkSession) as scratch:
        seen = scratch.write(seen, "turns")
        absent = lambda c, kind: F.lit(None).cast(kind).alias(c)
        short = seen.select("conv_id", F.lit(1).alias("part"), "pos", absent("turn", "long"), F.substring("role", 1, 1).alias("role"), absent("text", "string"), "fault")
        full = seen.select("conv_id", F.lit(2).alias("part"), "pos", "turn", "role", "text", "fault")
        both = short.unionByName(full)
        if every is not None:
            heads = every.select("conv_id").distinct()
            both = both.unionByName(heads.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), *[absent(c, k) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))]))
        return scratch.keep(scratch.write(map_batches(both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos"), _repaired, RESULT.format(key=key)), "repaired"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` with one row in five damaged, by crc32 of ``conv_id:turn``; nulls in it, and null roles and texts, are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


#: crc32 of an ASCII text in SQL, byte by byte and bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def oracle_sql() -> str:
    """The same by recursion in SQL: costs to go from the last turn backward, then the walk. States: 0 start, 1 system, 2 user, 3 assistant."""
    crc = CRC_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    least = "[least(c[1], 3 + least(c[3], 3 + c[4])), least(c[2], 3 + least(c[3], 3 + c[4])), least(c[3], 3 + c[4]), least(c[4], 3 + c[3])]"
    big = "1000000000"
    turn = lambda s, kept, goal: f"least(4 + t.c[{s}], CASE WHEN must THEN {big} ELSE extra + least(3 + t.c[{goal}], {kept}) END)"
    keep = lambda *ways: f"CASE initial {' '.join(f"WHEN '{i}' THEN t.c[{s}]" for i, s in ways)} ELSE {big} END"
    step = ", ".join((turn(1, keep(("s", 2), ("u", 3)), 3), turn(2, keep(("u", 3)), 3), turn(3, keep(("a", 4)), 4), turn(4, keep(("u", 3)), 3)))
    goal = "CASE w.s WHEN 3 THEN 4 ELSE 3 END"
    kept = "CASE WHEN w.s = 1 AND initial = 's' THEN 2 WHEN w.s <> 3 AND initial = 'u' THEN 3 WHEN w.s = 3 AND initial = 'a' THEN 4 END"
    return rf"""
    WITH RECURSIVE hit AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM hit, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
    faults AS (
        SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS previous,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM numbered),
    rows AS (SELECT *, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 3 ELSE 0 END AS extra FROM faults),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
               count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
               count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
    togo AS (
        SELECT conv_id, n + 1 AS pos, [0, 6, 3, 0] AS c FROM counts
        UNION ALL
        SELECT conv_id, pos, {least} FROM (
            SELECT r.conv_id, r.pos, [{step}] AS c FROM togo t JOIN rows r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.pos = t.pos - 1)),
    walk AS (
        SELECT conv_id, 1::BIGINT AS pos, 1 AS s, '' AS audit, [''] [1:0] AS said FROM counts
        UNION ALL
        SELECT conv_id, CASE WHEN edit IN ('D', 'K', 'R') THEN pos + 1 ELSE pos END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE goal END, audit || edit,
               CASE edit WHEN 'D' THEN said ELSE list_append(said, CASE WHEN edit = 'K' THEN role WHEN goal = 3 THEN 'user' ELSE 'assistant' END || ':' ||
                   CASE edit WHEN 'I' THEN '' ELSE text END) END
        FROM (
            SELECT w.*, r.role, r.text, {goal} AS goal, {kept} AS kept,
                   CASE WHEN a.c IS NOT NULL AND h.c[w.s] = 4 + a.c[w.s] THEN 'D' WHEN h.c[w.s] = 3 + h.c[{goal}] THEN 'I' WHEN a.c IS NULL THEN NULL
                        WHEN {kept} IS NOT NULL AND h.c[w.s] = extra + a.c[{kept}] THEN 'K' ELSE 'R' END AS edit
            FROM walk w JOIN togo h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.pos = w.pos
            LEFT JOIN togo a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.pos = w.pos + 1
            LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos)
        WHERE edit IS NOT NULL),
    done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM walk GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(h.c[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e
    LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN togo h ON h.conv_id IS NOT DISTINCT FROM e.conv_id AND h.pos = 1
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id"""
