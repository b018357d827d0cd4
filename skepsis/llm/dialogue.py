r"""Repair of conversations whose rows were lost, emptied, cut, repeated or given the wrong role.

A conversation is read in turn order through a Viterbi decoder whose states say which role may follow.  A state's survivor
is a leaf of a tree of backpointers; a node goes when no child or survivor refers to it, and as soon as all survivors share
an ancestor, the edits up to it are sent out.  So a task holds the unresolved rows of one conversation, however long it is.
Two paths to one state that cost the same have edits of which neither starts the other (the rows they have read are the same and
inserts are read with the row behind them), so their order is decided within the unresolved part and never changes later.

Order of rows: turn (nulls first), then role, then text.  Nulls in role or text are one space.  A null conv_id is a
conversation like any other.  Repeated rows are duplicates.  Extra columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import slices

BLANKS = "\x20\x09\x0A\x0B\x0C\x0D"
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5           # costs; CUT is added for a truncated row that stays
NONE, SYSTEM, USER, ASSISTANT = range(4)            # the last role given out
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
INSERTS = (((0, NONE), (1, USER), (2, ASSISTANT)), ((0, SYSTEM), (1, USER), (2, ASSISTANT)), ((0, USER), (1, ASSISTANT)), ((0, ASSISTANT), (1, USER)))
CLOSE = (0, 2, 1, 0)                                # inserts that end a conversation from each state
#: Whatever the rows to come, the first state ends at most so much dearer than the second: a second that costs more goes.
AT_MOST = {(ASSISTANT, NONE): 2, (USER, NONE): 7, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 5, (NONE, SYSTEM): 0, (ASSISTANT, USER): 5, (USER, ASSISTANT): 5, (NONE, ASSISTANT): 0, (NONE, USER): 5}

SCRIPT = "conv_id long, turn long, role string, text string, fault string, edit string, new_role string"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as damaged by crc32 of `conv_id:turn` (nulls: one space) modulo 20."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20).alias("kind"))
    return (d.filter("kind <> 0").withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault (blank, duplicate, truncated or null), a conversation in one partition and in order.

    One shuffle, by conversation: the numbering of equal rows and the order of turns sort within it, and both spill.
    """
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    stripped = F.rtrim("text", F.lit(BLANKS))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(stripped == "", "blank").when(F.col("again"), "duplicate").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated")
    return (d.withColumn("again", again).withColumn("fault", fault).drop("again")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"))


@lru_cache(None)
def transition(layer: tuple, initial: str, fault: str | None) -> tuple:
    """From the survivors ((state, cost), ...), in the order of their edits, over a row: (the new survivors, their common cost, moves).

    A move is (parent, edits).  Costs are relative to the cheapest survivor, so few different layers occur.
    """
    if fault in ("blank", "duplicate"):     # an insert is never better before a forced deletion than behind it
        return layer, DELETE, tuple((j, "D") for j in range(len(layer)))
    stays = CUT if fault == "truncated" else 0
    best: dict[int, tuple] = {}

    def offer(state, *path):
        if state not in best or path < best[state]:
            best[state] = path
    for j, (state, cost) in enumerate(layer):
        offer(state, cost + DELETE, j, "D")
        for k, at in INSERTS[state]:
            for role, to in NEXT[at].items():
                if k and role == "s":
                    continue
                if role == initial:
                    offer(to, cost + INSERT * k + stays, j, "I" * k + "K")
                if role != "s":
                    offer(to, cost + INSERT * k + stays + REROLE, j, "I" * k + "R")
    alive = {s: p for s, p in best.items() if not any(best[o][0] + AT_MOST[o, s] < p[0] for o in best if (o, s) in AT_MOST)}
    low = min(p[0] for p in alive.values())
    kept = sorted(alive.items(), key=lambda x: x[1][1:])
    return tuple((s, p[0] - low) for s, p in kept), low, tuple(p[1:] for _, p in kept)


class Node:
    """A row and the edits a path makes at it."""
    __slots__ = ("parent", "row", "edits", "children")

    def __init__(self, parent, row, edits):
        self.parent, self.row, self.edits, self.children = parent, row, edits, []


class Decoder:
    """Edits of one conversation, given out as (row, edits) once no later row can change them."""

    def __init__(self):
        self.root = Node(None, None, "")
        self.layer, self.leaves = ((NONE, 0),), [self.root]

    def read(self, row: tuple, initial: str, fault: str | None) -> Iterator[tuple]:
        self.layer, _, moves = transition(self.layer, initial, fault)
        old, self.leaves = self.leaves, []
        for j, edits in moves:
            node = Node(old[j], row, edits)
            old[j].children.append(node)
            self.leaves.append(node)
        for node in old:                        # references: children, or being a survivor
            while not node.children and node.parent is not None:
                node.parent.children.remove(node)
                node = node.parent
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            yield self.root.row, self.root.edits

    def end(self) -> Iterator[tuple]:
        """What is left, and (None, the inserts that close the conversation)."""
        _, j = min((cost + INSERT * CLOSE[state], j) for j, (state, cost) in enumerate(self.layer))
        path, node = [], self.leaves[j]
        while node is not self.root:
            path.append((node.row, node.edits))
            node = node.parent
        yield from reversed(path)
        yield None, "I" * CLOSE[self.layer[j][0]]


def edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the rows of `faults`: the edit script."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), *[(c, pa.string()) for c in ("role", "text", "fault", "edit", "new_role")]])
    decoder, conv, state, out = None, None, NONE, []

    def give(found):
        nonlocal state
        for row, edits in found:
            for e in edits:
                name = None
                if e in "IR":
                    name = "assistant" if state == USER else "user"
                elif e == "K":
                    name = row[2]
                if name is not None:
                    state = NEXT[state][name[0]]
                out.append((conv, None, None, "", None, "I", name) if e == "I" else (*row, e, name))

    for b in slices(batches, 1024):
        for row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]):
            if decoder is None or row[0] != conv:
                if decoder is not None:
                    give(decoder.end())
                decoder, conv, state = Decoder(), row[0], NONE
            initial = row[2][:1]
            give(decoder.read(row, initial if initial in ("s", "u", "a") else "", row[4]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if decoder is not None:
        give(decoder.end())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edit script of every conversation, in order within a partition.

    One row for each row read: `edit` K (kept), R (given `new_role`) or D (deleted, `new_role` null); and one for each inserted
    row (I: no turn or role, empty text).  The rows that stay, as `new_role` and `text`, are the repaired conversation: an
    optional system row, then user and assistant in turn, the assistant last; or nothing.
    """
    return faults(rows).mapInArrow(edit_rows, SCRIPT)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over `repair`: one row per conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    legal = {"su", "ua", "au"}
    at, n, out = None, 0, []
    low = high = last_turn = last = sha = audit = None
    kept = turns = illegal = cost = 0
    count: dict = {}

    def close():
        if n:
            out.append((at, 0 if low is None else high - low + 1 - turns, count["blank"], count["duplicate"], count["truncated"], illegal, cost, bytes(audit).decode(), sha.hexdigest()))

    for b in slices(batches, 4096):
        for conv, turn, role, text, fault, edit, name in zip(*[c.to_pylist() for c in b.columns]):
            if not n or conv != at:
                close()
                at, n, low, high, last_turn, last, kept, turns, illegal, cost = conv, 0, None, None, None, None, 0, 0, 0, 0
                count, sha, audit = dict.fromkeys(("blank", "duplicate", "truncated"), 0), hashlib.sha256(), bytearray()
            n += 1
            audit += edit.encode()
            cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (CUT if fault == "truncated" and edit in "KR" else 0)
            if name is not None:
                sha.update(f"{chr(10) if kept else ''}{name}:{text}".encode())
                kept += 1
            if edit == "I":
                continue
            if fault is not None:
                count[fault] += 1
            illegal += last is not None and last + role[:1] not in legal
            last = role[:1]
            if turn is not None:
                turns += turn != last_turn
                low, high, last_turn = turn if low is None else low, turn, turn
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def digest(script: DataFrame) -> DataFrame:
    """Per conversation of an edit script: gaps, faults, illegal neighbours, cost, edits and the hash of the repaired text.

    Works on the script as `repair` gives it, so there is no shuffle; the hash of one conversation is sequential by nature.
    """
    return script.mapInArrow(fold, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """`digest` of the repair of every damaged conversation; conversations that lost all rows have zeros and empty strings."""
    d = digest(repair(damage(rows))).withColumnRenamed("conv_id", "_id")
    ids = rows.select("conv_id").distinct()
    filled = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(d, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '') AS x FROM conversations),
crc AS (SELECT * EXCLUDE (x), xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, (len(x) // 2) + 1),
           lambda i: [(strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i]) - 1, -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) % 20 AS kind FROM raw),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM crc WHERE kind <> 0)),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
d AS (SELECT c, conv_id, turn, role, text, i, role[1:1] AS ini,
             CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
opt(q, k, role, q2) AS (VALUES ('0','','s','s'), ('0','','u','u'), ('0','I','a','a'), ('0','II','u','u'), ('s','','u','u'), ('s','I','a','a'), ('s','II','u','u'), ('u','','a','a'), ('u','I','u','u'), ('a','','u','u'), ('a','I','a','a')),
v AS (SELECT DISTINCT c, 0::BIGINT AS i, '0' AS q, 0 AS cost, '' AS audit FROM d
  UNION ALL
  SELECT * FROM (SELECT c, i, q, min(cost) AS cost, arg_min(audit, lpad(cost::VARCHAR, 12, '0') || audit) AS audit FROM (
    SELECT d.c, d.i, v.q, v.cost + 2 AS cost, v.audit || 'D' AS audit FROM v JOIN d ON d.c = v.c AND d.i = v.i + 1
    UNION ALL
    SELECT d.c, d.i, opt.q2, v.cost + 5 * len(opt.k) + CASE d.fault WHEN 'truncated' THEN 5 ELSE 0 END + CASE e WHEN 'R' THEN 1 ELSE 0 END, v.audit || opt.k || e
    FROM v JOIN d ON d.c = v.c AND d.i = v.i + 1 JOIN opt ON opt.q = v.q, (VALUES ('K'), ('R')) AS es(e)
    WHERE d.fault NOT IN ('blank', 'duplicate') AND ((e = 'K' AND d.ini = opt.role) OR (e = 'R' AND opt.role <> 's'))) GROUP BY c, i, q)),
fin AS (SELECT c, min(cost) AS cost, arg_min(audit, lpad(cost::VARCHAR, 12, '0') || audit) AS audit FROM (
    SELECT v.c, v.cost + CASE q WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END AS cost, v.audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit
    FROM v JOIN (SELECT c, max(i) AS n FROM d GROUP BY c) t ON t.c = v.c AND t.n = v.i) GROUP BY c),
let AS (SELECT c, j, audit[j : j] AS e, len(regexp_replace(audit[1 : j], 'I', '', 'g')) AS i, len(regexp_replace(audit[1 : j - 1], 'D', '', 'g')) AS done FROM (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS j FROM fin)),
placed AS (SELECT l.c, l.j, l.e, l.done, d.role, CASE WHEN l.e = 'I' THEN '' ELSE d.text END AS text,
                  max(CASE WHEN l.done = 0 AND l.e = 'K' AND d.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.c) AS s
           FROM let l LEFT JOIN d ON d.c = l.c AND d.i = l.i AND l.e <> 'I' WHERE l.e <> 'D'),
said AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (done - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS t FROM placed GROUP BY c),
pairs AS (SELECT c, count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, ini, lag(ini) OVER (PARTITION BY c ORDER BY i) AS before FROM d) GROUP BY c),
st AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
              count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM d GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN fin USING (c) LEFT JOIN pairs USING (c) LEFT JOIN said USING (c)
"""
