"""Conversation structure repair: the cheapest edits that make the roles of a conversation s?(ua)+ or nothing.

Rows are kept (0), given the role user or assistant (3) or deleted (4); rows without text (3) may be inserted anywhere.
Blank and repeated rows have to go, and a row that stays but breaks off costs 3. A Viterbi pass over the rows in turn
order holds one survivor for each state of the grammar. Survivors are leaves of a tree of backpointers whose nodes
count what hangs on them: once all survivors have a common ancestor, the edits above it are decided and leave, and
branches that no survivor needs are freed. Survivors that no continuation can make cheapest are dropped at once.

Equal costs go to the ASCII-least string of edits (D, I, K, R). The order of the survivors' whole undecided strings is
carried along as short ranks, renewed each row, so a tie costs no walk back. A string determines its states and costs,
hence of two equally cheap ways to one state neither is the other's beginning, and the lesser one stays lesser.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compassframe.llm.common import documents, small_batches

DELETE, RENAME, INSERT, BROKEN = 4, 3, 3, 3
START, S, U, A = range(4)
USER, ASSISTANT = "user", "assistant"
#: Where a role's first letter leads from a state.
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
CHARACTER = "[^\\x20\\x09-\\x0D]"


class Node:
    """An edit that some survivor has taken, below the edits before it."""

    __slots__ = ("above", "edit", "role", "below", "held")

    def __init__(self, above: Node | None, edit: str, role: str | None):
        self.above, self.edit, self.role, self.below, self.held = above, edit, role, 0, 0
        if above is not None:
            above.below += 1


class Repair:
    """One conversation's pass. push() takes rows in order and finish() ends it; both give the edits decided so far,
    as (edit, new role)."""

    def __init__(self):
        self.root, self.new = Node(None, "", None), []
        self.live = {START: (0, "a", self.root)}
        self._insert(self.live)
        self._settle({}, self.live)

    @staticmethod
    def _offer(states: dict, state: int, cost: int, key: str, node: Node, edit: str, role: str | None) -> None:
        now = states.get(state)
        if now is None or (cost, key) < now[:2]:
            states[state] = (cost, key, (node, edit, role))

    def _made(self, states: dict) -> None:
        """Gives the survivors that were offered their nodes."""
        for state, (cost, key, node) in states.items():
            if isinstance(node, tuple):
                states[state] = (cost, key, Node(*node))
                self.new.append(states[state][2])

    def _insert(self, states: dict) -> None:
        for state in (START, S, A):
            if state in states:
                cost, key, node = states[state]
                self._offer(states, U, cost + INSERT, key + "I", node, "I", USER)
        self._made(states)
        if U in states:
            cost, key, node = states[U]
            self._offer(states, A, cost + INSERT, key + "I", node, "I", ASSISTANT)
        self._made(states)
        cost = {s: x[0] for s, x in states.items()}
        least = lambda *pairs: min((cost[s] + extra for s, extra in pairs if s in cost), default=None)
        for state, bound in ((START, least((A, DELETE))), (S, least((A, 0), (START, 0))), (A, least((START, 0)))):
            if state in cost and bound is not None and cost[state] > bound:
                del states[state]  # whatever follows is cheaper from the other state

    def _free(self, node: Node) -> None:
        while node is not self.root and not node.below and not node.held:
            node, above = node.above, node
            above.above = None
            node.below -= 1

    def _settle(self, old: dict, new: dict) -> None:
        for _, _, node in new.values():
            node.held += 1
        for _, _, node in old.values():
            node.held -= 1
            self._free(node)
        for node in self.new:
            if node.above is not None:  # else freed already
                self._free(node)
        self.new = []
        # the same order by short keys: a survivor that continues another by inserted rows keeps that relation
        ordered = sorted(new.items(), key=lambda x: x[1][1])
        fresh, base, first = {}, None, 97
        for state, (cost, key, node) in ordered:
            rest = key[len(base[0]) :] if base and key.startswith(base[0]) and not key[len(base[0]) :].strip("I") else None
            if rest is None:
                base = (key, chr(first))
                first += 1
                rest = ""
            fresh[state] = (cost, base[1] + rest, node)
        self.live = fresh

    def push(self, initial: str, must_go: bool, broken: bool) -> list[tuple[str, str | None]]:
        states, extra = {}, BROKEN if broken else 0
        for state, (cost, key, node) in self.live.items():
            self._offer(states, state, cost + DELETE, key + "D", node, "D", None)
            if not must_go:
                if (state, initial) in NEXT:
                    self._offer(states, NEXT[state, initial], cost + extra, key + "K", node, "K", None)
                to, role = (A, ASSISTANT) if state == U else (U, USER)
                self._offer(states, to, cost + RENAME + extra, key + "R", node, "R", role)
        self._made(states)
        self._insert(states)
        self._settle(self.live, states)
        return self._decided()

    def _decided(self) -> list[tuple[str, str | None]]:
        """Edits between the root and the survivors' last common ancestor."""
        if self.root.below != 1 or self.root.held:
            return []
        path, node = [], next(iter(self.live.values()))[2]
        while node is not self.root:
            path.append(node)
            node = node.above
        out = []
        while path and self.root.below == 1 and not self.root.held:
            self.root = path.pop()
            self.root.above = None
            out.append((self.root.edit, self.root.role))
        return out

    def finish(self) -> tuple[int, list[tuple[str, str | None]]]:
        """The cost of the cheapest edits, and those not given yet."""
        cost, _, node = min(self.live[s] for s in (START, A) if s in self.live)
        path = []
        while node is not self.root:
            path.append((node.edit, node.role))
            node = node.above
        return cost, path[::-1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, with one fault in four by crc32('conv_id:turn') % 20; nulls count as a space.

    0 marks the row as gone, 1 empties the text, 2 takes its full stops, exclamation and question marks, 3 repeats the
    row and 4 makes the role user.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, USER).otherwise(known("role")).alias("role"), text.alias("text"), (fault == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def fault_of(text: Column, nth: Column) -> Column:
    """A row's first fault: blank, duplicate (not the first of its role and text) or truncated; else null."""
    return (F.when(~text.rlike(CHARACTER), "blank").when(nth > 1, "duplicate")
            .when(~text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated"))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation: conv_id, step (from 1), edit (K, R, D or I), fault, turn, role and text (of the row
    as it was; null role and empty text for an inserted one) and new_role (null if deleted).

    Reads conv_id, turn, role, text and, if there, gone; other columns are left alone. Conversations are ordered by turn
    (nulls first), ties by role and text. Null roles and texts count as one space, which is blank; a null conv_id is a
    conversation. Roles count by their first letter; a row whose letter is none of s, u, a can be given a role or
    deleted, not kept. Rows marked gone are absent but their conversation is not: each gives a row of nulls.
    Rows of a conversation come out in order within their partition. Empty tables give none; texts are kept whole.

    One shuffle, by conv_id, and spillable sorts: repeated rows are found by a window inside the partitions of that
    shuffle. A conversation is streamed; memory holds the rows whose edits are still open and four survivors.
    """
    spark = rows.sparkSession
    id_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    known = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    dealt = known.repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn")))
    marked = dealt.withColumn("nth", nth).select("conv_id", "turn", "role", "text", "gone", fault_of(F.col("text"), F.col("nth")).alias("fault"))
    ordered = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    names = ["conv_id", "step", "edit", "fault", "turn", "role", "text", "new_role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_rows, pass_, step, types, out = None, deque(), None, 0, None, []

        def told(edits: Iterable[tuple[str, str | None]]) -> None:
            nonlocal step
            for edit, new_role in edits:
                step += 1
                turn, role, text, fault = (None, None, "", None) if edit == "I" else open_rows.popleft()
                out.append((now[0], step, edit, fault, turn, role, text, role if edit == "K" else new_role))

        def end() -> None:
            if pass_ is not None:
                told(pass_.finish()[1])

        def batch_of() -> pa.RecordBatch:
            kinds = [types[0], pa.int64(), pa.string(), pa.string(), types[1], pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            types = batch.schema.field("conv_id").type, batch.schema.field("turn").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")]
            for conv, turn, role, text, absent, fault in zip(*columns, strict=True):
                if now is None or conv != now[0]:
                    end()
                    now, pass_, step = (conv,), None, 0
                if absent:
                    out.append((conv, None, None, None, None, None, None, None))
                    continue
                if pass_ is None:
                    pass_ = Repair()
                open_rows.append((turn, role, text, fault))
                told(pass_.push(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            if out:
                yield batch_of()
                out.clear()
        end()
        if out:
            yield batch_of()

    with small_batches(spark, 1000):
        return ordered.mapInArrow(run, f"conv_id {id_type}, step bigint, edit string, fault string, turn {turn_type}, role string, text string, new_role string")


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation of repair()'s rows, read in their order: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256."""
    id_type = edits.schema["conv_id"].dataType.simpleString()
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counted, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind, done = None, None, None, []

        def fresh() -> dict:
            return dict.fromkeys(counted, 0) | {"audit": [], "hash": hashlib.sha256(), "low": None, "high": None, "turns": 0, "before": None, "rows": 0}

        def close() -> None:
            if now is not None:
                gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
                done.append((now[0], gaps, *[state[c] for c in counted[1:]], "".join(state["audit"]), state["hash"].hexdigest()))

        def batch_of() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "fault", "turn", "role", "text", "new_role")]
            for conv, edit, fault, turn, role, text, new_role in zip(*columns, strict=True):
                if now is None or conv != now[0]:
                    close()
                    now, state = (conv,), fresh()
                if edit is None:
                    continue
                state["audit"].append(edit)
                state["cost"] += {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}[edit]
                if edit != "I":
                    if fault:
                        state[fault] += 1
                        if fault == "truncated" and edit != "D":
                            state["cost"] += BROKEN
                    if turn is not None and turn != state["high"]:
                        state["turns"] += 1
                        state["high"] = turn
                        state["low"] = turn if state["low"] is None else state["low"]
                    initial = role[:1]
                    if state["before"] is not None and state["before"] + initial not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["before"] = initial
                if edit != "D":
                    state["hash"].update((("\n" if state["rows"] else "") + f"{new_role}:{text}").encode("utf-8", "surrogatepass"))
                    state["rows"] += 1
            if done:
                yield batch_of()
                done.clear()
        close()
        if done:
            yield batch_of()

    fields = ", ".join(f"{c} bigint" for c in counted)
    return edits.mapInArrow(run, f"conv_id {id_type}, {fields}, audit string, repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damage(documents(spark, sf_dir, "conversations"))))


def _step_sql() -> str:
    """The survivors after one row in SQL: a survivor is a cost of nine digits followed by its edits."""
    add = lambda v, c, e: f"(CASE WHEN {v} IS NOT NULL THEN lpad((left({v}, 9)::INTEGER + {c})::VARCHAR, 9, '0') || substr({v}, 10) || '{e}' END)"
    keep = lambda v, letter: f"(CASE WHEN NOT x.go AND x.i = '{letter}' THEN {add(v, 'x.e', 'K')} END)"
    role = lambda v: f"(CASE WHEN NOT x.go THEN {add(v, '3 + x.e', 'R')} END)"
    return f"""SELECT conv_id, k + 1, turns,
        {add('v0', 4, 'D')} AS v0,
        least({add('vs', 4, 'D')}, {keep('v0', 's')}) AS vs,
        least({add('vu', 4, 'D')}, {keep('v0', 'u')}, {keep('vs', 'u')}, {keep('va', 'u')}, {role('v0')}, {role('vs')}, {role('va')}) AS vu,
        least({add('va', 4, 'D')}, {keep('vu', 'a')}, {role('vu')}) AS va
      FROM (SELECT *, turns[k + 1] AS x FROM closed WHERE k < len(turns))"""


def _oracle() -> str:
    space = "chr(32)"
    inserted = "(CASE WHEN {0} IS NOT NULL THEN lpad((left({0}, 9)::INTEGER + 3)::VARCHAR, 9, '0') || substr({0}, 10) || 'I' END)"
    crc = ("xor(list_reduce(list_transform(range(1, length(key) + 1), lambda p: ascii(key[p])::BIGINT), lambda c, b: xor(c >> 8, "
           "list_reduce(range(0, 8), lambda t, z: CASE WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(c, b) & 255)), 4294967295), 4294967295)")
    step = _step_sql()
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, {space}) AS role, coalesce(text, {space}) AS text,
        coalesce(conv_id::VARCHAR, {space}) || ':' || coalesce(turn::VARCHAR, {space}) AS key FROM conversations),
hit AS (SELECT conv_id, turn, role, text, {crc} % 20 AS f FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN
        regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
faults AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS ahead FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (ahead IS NOT NULL AND ahead || i NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'i': i, 'role': role, 'text': text, 'go': fault IN ('blank', 'duplicate'), 'e': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END}} ORDER BY p) AS turns
        FROM faults GROUP BY conv_id),
closed(conv_id, k, turns, v0, vs, vu, va) AS (
    SELECT conv_id, 0::BIGINT, turns, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM facts UNION ALL
    SELECT conv_id, k, turns, v0, vs, vu, least(va, {inserted.format('vu')}) FROM (
        SELECT conv_id, k, turns, v0, vs, least(vu, {inserted.format('v0')}, {inserted.format('vs')}, {inserted.format('va')}) AS vu, va
        FROM ({step}) AS stepped(conv_id, k, turns, v0, vs, vu, va))),
ended AS (SELECT conv_id, turns, least(v0, va) AS v FROM closed WHERE k = len(turns)),
letters AS (SELECT conv_id, turns, v, unnest(range(10, length(v) + 1)) AS pos FROM ended),
edits AS (SELECT conv_id, pos, v[pos] AS edit, turns[count(*) FILTER (v[pos] <> 'I') OVER w] AS x, count(*) FILTER (v[pos] <> 'D') OVER w AS nth FROM letters
        WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
headed AS (SELECT *, max(CASE WHEN edit = 'K' AND nth = 1 AND x.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS head FROM edits WHERE edit <> 'D'),
told AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN x.role WHEN (nth - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
        CASE WHEN edit = 'I' THEN '' ELSE x.text END, chr(10) ORDER BY pos)) AS h FROM headed GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(v, 9)::BIGINT, 0) AS cost,
       coalesce(substr(v, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP13_SQL = _oracle()
