"""Repair of conversations' structure at least cost, with an audit letter for each edit.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then by a hash of the text). A row's
first fault counts: blank, a repeat of an earlier row's role and text, or truncated (the last character isn't a
sentence's end). The repaired conversation has an optional system turn, then user and assistant in turn, or nothing.

The edits are the edges of a graph whose nodes are (rows read, what the output ends with). An edge's weight is
one big integer: its high digits are the cost, its low digits are the edit's letter at the letter's position in the
audit, of fixed width and zero behind the last letter. So the least integer is the least cost and among
equals the ASCII-least audit, and a plain minimum at each node decides everything. (Two paths of equal
cost to the same node can't be prefixes of each other: what is longer has inserts, which cost more.)
What all nodes' audits have in common is settled and moved out of the integers from time to time, so they
stay small in long conversations.

Nothing holds a conversation: repeats are found by a window that Spark sorts, plans read a conversation's rows
without texts as a stream, and repaired rows are made in a second stream, headed by the plan.

Null roles and texts are one space. Rows without a conversation id make one conversation. An empty table gives no rows.
Texts of any length are taken whole; columns other than conv_id, turn, role, text and dropped are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, of

#: Fixed values of the task: costs, and what a sentence ends with.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ENDS = ".!?"
SPACE = " \t\n\x0b\f\r"
#: What the output ends with: nothing, a system, user or assistant turn; and what may follow.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LETTERS = "DIKR"  # in ASCII order; a letter is its place, from 1, in three bits
WIDTH = 64  # letters that are kept in the integers at first
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROW = "conv_id long, position long, edit string, role string, text string"


def _n(kind: str):
    return F.coalesce(F.col(kind).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) damaged by the hash of `conv_id:turn`; dropped rows stay, marked."""
    t = of(turns, conv_id="long", turn="long", role="string", text="string")
    code = F.crc32(F.concat(_n("conv_id"), F.lit(":"), _n("turn")).cast("binary")) % 20
    t = t.select("conv_id", "turn", _n("role").alias("role"), _n("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    t = t.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("dropped"), F.when(F.col("code") == 3, 2).otherwise(1).alias("n"))
    return t.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def _rows(turns: DataFrame) -> DataFrame:
    t = of(turns, conv_id="long", turn="long", role="string", text="string", dropped="boolean")
    t = t.withColumns({"role": _n("role"), "text": _n("text"), "dropped": F.coalesce("dropped", F.lit(False))})
    return t.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("b"), F.col("text"))})


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


class Repair:
    """The least integers at the nodes behind the rows read so far, for one conversation."""

    def __init__(self, conv):
        self.conv = conv
        self.width = WIDTH
        self.least: list[int | None] = [0, None, None, None]
        self.letters = [0, 0, 0, 0]  # in each node's audit, without what is settled
        self.base, self.settled = 0, []
        self.turns: list = [None, None, 0]  # first, last, distinct
        self.faults = [0, 0, 0, 0]
        self.illegal, self.initial, self.any = 0, None, False

    def edge(self, node: int, cost: int, letter: str) -> tuple[int, int]:
        at = self.letters[node]
        return self.least[node] + (cost << 3 * self.width) + (1 + LETTERS.index(letter) << 3 * (self.width - 1 - at)), at + 1

    def step(self, edges) -> None:
        """One layer of the graph: edges (from, to, cost, letter); a letter of "" stays where it is."""
        least: list[int | None] = [None] * 4
        letters = [0] * 4
        for a, b, cost, letter in edges:
            if self.least[a] is None:
                continue
            value, n = self.edge(a, cost, letter) if letter else (self.least[a], self.letters[a])
            if least[b] is None or value < least[b]:
                least[b], letters[b] = value, n
        self.least, self.letters = least, letters

    def gap(self) -> None:
        """Inserts between rows; more than two never pay, since two lead back to the same node."""
        for _ in range(2):
            self.step([(k, k, 0, "") for k in range(4)] + [(a, b, INSERT, "I") for b in (USER, ASSISTANT) for a in BEFORE[b]])

    def add(self, turn, role: str, fault: int) -> None:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        first, last, distinct = self.turns
        if turn is not None and turn != last:
            self.turns = [turn if first is None else first, turn, distinct + 1]
        self.faults[fault] += 1
        initial = role[:1]
        if self.any and (self.initial or "") + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.any, self.initial = True, initial
        if max(self.letters) + 3 > self.width:
            self.settle()
        self.gap()
        edges = [(k, k, DELETE, "D") for k in range(4)]
        if fault not in (1, 2):
            more = TRUNCATED * (fault == 3)
            own = INITIALS.get(initial)
            edges += [(a, own, KEEP + more, "K") for a in BEFORE.get(own, ())]
            edges += [(a, b, REROLE + more, "R") for b in NAMES for a in BEFORE[b]]
        self.step(edges)

    def text_of(self, low: int, n: int) -> str:
        return "".join(LETTERS[int(d) - 1] for d in f"{low:0{self.width}o}"[:n])

    def drop(self) -> None:
        """Takes nodes away that can't lie on a cheapest path: what follows NOTHING or SYSTEM may also follow
        ASSISTANT, but for a system turn kept, which can be deleted there; and USER is an insert from ASSISTANT."""
        cost = [float("inf") if v is None else v >> 3 * self.width for v in self.least]
        reach = min(cost[ASSISTANT], cost[USER] + INSERT)
        for k, more in ((NOTHING, DELETE), (SYSTEM, 0)):
            if cost[k] > reach + more:
                self.least[k], self.letters[k] = None, 0

    def settle(self) -> None:
        self.drop()
        bits, on = 3 * self.width, [k for k in range(4) if self.least[k] is not None]
        low = {k: self.least[k] & (1 << bits) - 1 for k in on}
        differ = 0
        for k in on:
            differ |= low[k] ^ low[on[0]]
        same = min(self.width - -(-differ.bit_length() // 3), *(self.letters[k] for k in on))
        cost = min(self.least[k] >> bits for k in on)
        self.base += cost
        self.settled.append(self.text_of(low[on[0]], same))
        wider = self.width * (same < self.width // 2)
        for k in on:
            rest = low[k] << 3 * same & (1 << bits) - 1
            self.least[k] = ((self.least[k] >> bits) - cost << bits | rest) << 3 * wider
            self.letters[k] -= same
        self.width += wider

    def close(self) -> tuple:
        if self.any:
            if max(self.letters) + 2 > self.width:
                self.settle()
            self.gap()
        value, k = min((self.least[k], k) for k in (NOTHING, ASSISTANT) if self.least[k] is not None)
        bits = 3 * self.width
        audit = "".join(self.settled) + self.text_of(value & (1 << bits) - 1, self.letters[k])
        first, last, distinct = self.turns
        gaps = 0 if first is None else last - first + 1 - distinct
        return self.conv, gaps, *self.faults[1:], self.illegal, self.base + (value >> bits), audit


def _planned(batches):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [pa.string() if n == "audit" else pa.int64() for n in names]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    done, open_ = [], None
    for b in batches:
        for conv, turn, role, fault, dropped in zip(*(b.column(i).to_pylist() for i in range(5))):
            if open_ is None or open_.conv != conv:
                done += [open_.close()] if open_ else []
                open_ = Repair(conv)
            if not dropped:
                open_.add(turn, role, fault)
        if len(done) >= 1000:
            yield batch(done)
            done = []
    done += [open_.close()] if open_ else []
    if done:
        yield batch(done)


def plan_repairs(turns: DataFrame) -> DataFrame:
    """A row for each conversation: gaps in its turns, faults, illegal neighbours, least cost and audit.

    The repeats' window and the sort use the one shuffle by conversation, in which there are no texts.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    t = _rows(turns).withColumn("seen", F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(*ENDS), 0).otherwise(3))
    t = t.select("conv_id", "turn", "role", "h1", "h2", "seen", "dropped").repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())) > 1
    t = t.withColumn("fault", F.when(F.col("seen") == 1, 1).when(earlier, 2).otherwise(F.col("seen")))
    t = t.sortWithinPartitions("conv_id", *_order(), "fault")
    return t.select("conv_id", "turn", "role", "fault", "dropped").mapInArrow(_planned, PLAN)


def _applied(batches):
    names = ["conv_id", "position", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    conv, audit, at, place, node = None, "", 0, 0, NOTHING

    def put(edit, kind, role, text):
        nonlocal place, node
        out.append((conv, place, edit, role, text))
        place, node = place + 1, kind

    def following():
        return ASSISTANT if node == USER else USER

    def inserts():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("I", kind := following(), NAMES[kind], "")
            at += 1

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
        out.clear()
        return made

    held = 0
    for b in batches:
        for c, plan, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if plan is not None:  # a conversation's first row
                conv, audit, at, place, node = c, plan, 0, 0, NOTHING
                inserts()
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                put("K", INITIALS[role[:1]], role, text)
            elif edit == "R":
                put("R", kind := following(), NAMES[kind], text)
            inserts()
            held += len(text)
            if len(out) >= 1000 or held > 1 << 22:
                if out:
                    yield batch()
                held = 0
    if out:
        yield batch()


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (conv_id, position, edit, role, text) of the repaired conversations, in order within each partition."""
    t = _rows(turns).where(~F.col("dropped")).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "h1", "h2", "text")
    none = {c: F.lit(None).cast(k) for c, k in (("turn", "long"), ("role", "string"), ("h1", "long"), ("h2", "long"), ("text", "string"))}
    t = t.unionByName(plans.select("conv_id", "audit", *[v.alias(c) for c, v in none.items()]))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    return t.select("conv_id", "audit", "role", "text").mapInArrow(_applied, ROW)


def _digested(batches):
    done, conv, sha = [], None, None

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])
        done.clear()
        return made

    for b in batches:
        for c, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if place == 0:
                if sha:
                    done.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if len(done) >= 1000:
            yield batch()
    if sha:
        done.append((conv, sha.hexdigest()))
    if done:
        yield batch()


def repair_digests(turns: DataFrame) -> DataFrame:
    """The plan of each conversation, with the SHA-256 of its repaired rows `role:text`, joined by line feeds."""
    plans = cut(plan_repairs(turns))
    rows = repaired(turns, plans).select("conv_id", "position", "role", "text")
    digests = rows.mapInArrow(_digested, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "_id")
    out = plans.join(digests, plans["conv_id"].eqNullSafe(digests["_id"]), "left").drop("_id")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))


def _oracle() -> str:
    """DuckDB: CRC-32 bit by bit, and one recursion step a row over four nodes of (cost, audit, lines)."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    octet = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: {octet}), 4294967295)"
    put = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': list_append({s}.t, {line})}}"
    least = lambda *s: f"list_min([{', '.join(s)}])"
    to_user, to_assistant = "least(n0, n1, n3)", "n2"
    layer = f"{least('n2', put('i2', INSERT, 'I', "'user:'"))} AS m2, {least('n3', put('n2', INSERT, 'I', "'assistant:'"))} AS m3"
    inserted = lambda of: f"(SELECT * EXCLUDE (n2, n3, i2, m2, m3), m2 AS n2, m3 AS n3 FROM (SELECT *, {layer} FROM (SELECT *, {to_user} AS i2 FROM {of})))"
    closed = inserted(inserted("paths"))
    gone = lambda s: f"{{'c': {s}.c + {DELETE}, 'a': {s}.a || 'D', 't': {s}.t}}"
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    cost = lambda n: f"(CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE {n} + (fault = 3)::BIGINT * {TRUNCATED} END)"
    own = lambda initial: f"(CASE WHEN left(role, 1) = '{initial}' THEN {cost(KEEP)} ELSE 1000000000 END)"
    said = "role || ':' || text"
    return f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS code FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[{ENDS}]', '', 'g') ELSE text END AS text,
         unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) || left(role, 1) AS pair
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS n0, {never} AS n1, {never} AS n2, {never} AS n3 FROM counted
  UNION ALL
  SELECT conv_id, i + 1, {gone('n0')}, {least(gone('n1'), put('n0', own('s'), 'K', said))},
         {least(gone('n2'), put('u', own('u'), 'K', said), put('u', cost(REROLE), 'R', "'user:' || text"))},
         {least(gone('n3'), put('n2', own('a'), 'K', said), put('n2', cost(REROLE), 'R', "'assistant:' || text"))}
  FROM (SELECT p.*, {to_user} AS u, j.role, j.text, j.fault FROM ({closed}) p
        JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1)),
ended AS (
  SELECT c.conv_id, {least('n0', 'n3')} AS best FROM ({closed}) p
  JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM every.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM every.conv_id
"""


ORACLE = _oracle()
