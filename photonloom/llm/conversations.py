"""Conversation structure repair by secondary-sorted streaming.

Rows are partitioned by conversation and sorted by turn; one pass of mapInPandas carries the state of a dynamic program
from row to row and over the borders of Arrow batches. A repaired conversation reads `(s?(ua)+)?` in the initials of its
roles, which an automaton of four states follows. Per state the pass holds the least cost, the order of the edit strings that
reach it, and a running hash of the repaired text; the step for a kind of row is worked out once and looked up afterwards.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3, and a truncated row
that is not deleted 3. Blank and duplicate rows have to be deleted. Of the cheapest edit strings the ASCII-least is taken: all
strings that end at a row hold as many letters other than I as there are rows, and end in one, so that none is the beginning of
another, and the order of two strings stays whatever follows them. One byte per row and state points back; beyond SPILL_BYTES
these go to an unnamed temporary file of the task, so that a conversation of any length needs the memory of its longest row
and of its edit string. Earlier occurrences of a role and text are found by an aggregation over the rows before the pass, with
partial sums in each task, and joined back where there are several; equality is that of two 64-bit hashes.

Defined results: null conversation ids are one conversation; a null turn comes first and has no part in the gaps; rows of
one turn are ordered by role and text, and equal ones count as duplicates; a null role or text is one space; a role
without an initial, or with one other than s, u or a, cannot be kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of backpointers kept in memory per conversation.
SPILL_BYTES = 1 << 22
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
SPACES, STOPS = " \t\n\x0b\f\r", (".", "!", "?")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LETTERS = "DKR"
USER, ASSISTANT = "user", "assistant"
#: States: nothing yet, after s, after u, after a. What an insertion or a new role has to be, and where it leads.
NEXT = {0: (USER, 2), 1: (USER, 2), 2: (ASSISTANT, 3), 3: (USER, 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)
_OUT = "key string, no_key boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ROW = ["key", "no_key", "turn", "has_turn", "role", "text", "fault", "gone"]


def inserted(state: int, n: int) -> tuple[list[str], int]:
    roles = []
    for _ in range(n):
        role, state = NEXT[state]
        roles.append(role)
    return roles, state


def step(costs: tuple, order: tuple, initial: str, must_go: bool, cut: bool) -> tuple[int, tuple, tuple, tuple]:
    """One row: added cost, costs relative to it, order of the strings, and per state (from, insertions, letter). A cost
    of None: a state that nothing reaches."""
    best: dict[int, tuple] = {}
    for p, c in enumerate(costs):
        if c is None:
            continue
        for n in range(3):
            at = inserted(p, n)[1]
            ways = [("D", at, DELETE)]
            if not must_go:
                ways += [("K", KEPT[at, initial], KEEP + CUT * cut)] if (at, initial) in KEPT else []
                ways.append(("R", NEXT[at][1], REROLE + CUT * cut))
            for letter, to, cost in ways:
                found = (c + INSERT * n + cost, order[p], "I" * n + letter, p, n)
                if to not in best or found < best[to]:
                    best[to] = found
    least = min(x[0] for x in best.values())
    ranks = {s: i for i, (_, s) in enumerate(sorted(((x[1], x[2]), s) for s, x in best.items()))}
    return (least, tuple(best[s][0] - least if s in best else None for s in range(4)), tuple(ranks.get(s, -1) for s in range(4)),
            tuple((best[s][3], best[s][4], best[s][2][-1]) if s in best else None for s in range(4)))


def ending(costs: tuple, order: tuple) -> tuple[int, int, int]:
    """Added cost, state and insertions of the cheapest end."""
    ends = [(c + INSERT * n, order[p], "I" * n, p, n) for p, c in enumerate(costs) if c is not None for n in range(3) if inserted(p, n)[1] in FINAL]
    cost, _, _, p, n = min(ends)
    return cost, p, n


class _Pointers:
    """Backpointers of one conversation, four bytes a row."""

    def __init__(self, spill_bytes: int):
        self.held, self.file, self.spill_bytes = bytearray(), None, spill_bytes

    def add(self, four: bytes) -> None:
        self.held += four
        if len(self.held) >= self.spill_bytes:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held.clear()

    def backwards(self):
        """The four bytes of each row, the last row first."""
        yield from (self.held[i:i + 4] for i in range(len(self.held) - 4, -1, -4))
        if self.file:
            end = self.file.tell()
            while end:
                start = max(0, end - self.spill_bytes // 4 * 4)
                self.file.seek(start)
                part = self.file.read(end - start)
                yield from (part[i:i + 4] for i in range(len(part) - 4, -1, -4))
                end = start
            self.file.close()


class Repair:
    """The state of one conversation between rows."""

    _steps: dict[tuple, tuple] = {}

    def __init__(self, key: tuple, spill_bytes: int = SPILL_BYTES):
        self.key, self.pointers = key, _Pointers(spill_bytes)
        self.cost, self.costs, self.order = 0, (0, None, None, None), (0, -1, -1, -1)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.faults = [0, 0, 0, 0]
        self.illegal, self.before, self.first_turn, self.last_turn, self.turns = 0, None, None, None, 0

    def _extended(self, state: int, n: int, role: str | None, text: str):
        h = self.hashes[state]
        new, at = inserted(state, n)
        lines = [f"{r}:" for r in new] + ([] if role is None else [f"{role}:{text}"])
        if lines:
            h = h.copy()
            h.update(("\n" * (state != 0) + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return h

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault != BLANK and self.before == (turn, role, text):
            fault = DUPLICATE
        self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in ("su", "ua", "au")
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        self.before = (turn, role, text)
        asked = (self.costs, self.order, role[:1] if role[:1] in ("s", "u", "a") else "", fault in (BLANK, DUPLICATE), fault == TRUNCATED)
        done = self._steps.get(asked)
        if done is None:
            added, costs, order, back = step(*asked)
            code = bytes(255 if b is None else b[0] | b[1] << 2 | LETTERS.index(b[2]) << 4 for b in back)
            done = self._steps[asked] = added, costs, order, back, code
        added, self.costs, self.order, back, code = done
        self.cost += added
        self.pointers.add(code)
        hashes = []
        for b in back:
            if b is None:
                hashes.append(None)
            else:
                p, n, letter = b
                hashes.append(self._extended(p, n, None if letter == "D" else role if letter == "K" else NEXT[inserted(p, n)[1]][0], text))
        self.hashes = hashes

    def end(self) -> tuple:
        """The row of this conversation, as in _OUT."""
        added, state, n = ending(self.costs, self.order)
        digest = self._extended(state, n, None, "").hexdigest()
        letters = ["I" * n]
        for four in self.pointers.backwards():
            b = four[state]
            letters.append(LETTERS[b >> 4] + "I" * (b >> 2 & 3))
            state = b & 3
        gaps = min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return (*self.key, gaps, *self.faults[1:], self.illegal, self.cost + added, "".join(letters)[::-1], digest)


def _edited(spill_bytes: int):
    def edit(frames):
        now = None
        for frame in frames:
            out = []
            for key, no_key, turn, has_turn, role, text, fault, gone in zip(*(frame[c].tolist() for c in _ROW)):
                if now is None or now.key != (key, no_key):
                    if now is not None:
                        out.append(now.end())
                    now = Repair((key, no_key), spill_bytes)
                if not gone:
                    now.add(turn if has_turn else None, role, text, fault)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        if now is not None:
            yield pd.DataFrame([now.end()], columns=[c.split()[0] for c in _OUT.split(", ")])

    return edit


def _space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each row by crc32 of `conv_id:turn` modulo 20 dropped (kept here as gone, so that its
    conversation stays), emptied, without its stops, repeated, or given to the user."""
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    role, text = F.when(F.col("kind") == 4, F.lit(USER)).otherwise(_space("role")), _space("text")
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate(text, "".join(STOPS), "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds `fault`, the first of blank (1), duplicate (2), truncated (3) or 0; rows of (conv_id, turn, role, text, gone)."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.withColumn("_h1", F.xxhash64("role", "text")).withColumn("_h2", F.xxhash64(F.lit(1), "role", "text")).withColumn("_open", ~F.col("gone") & (body != ""))
    key = ["_conv", "_no_conv", "_h1", "_h2"]
    rows = rows.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("_no_conv", F.col("conv_id").isNull())
    seen = rows.where("_open").groupBy(*key).agg(F.count("*").alias("_n"), F.min(F.struct("turn")).alias("_first")).where("_n > 1").drop("_n")
    rows = rows.join(seen, key, "left")
    fault = F.when(body == "", BLANK).when(F.struct("turn") > F.col("_first"), DUPLICATE).when(~F.right(body, F.lit(1)).isin(*STOPS), TRUNCATED).otherwise(0)
    return rows.withColumn("fault", F.when(F.col("gone"), 0).otherwise(fault))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("_conv", "_no_conv", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.col("turn").isNotNull().alias("has_turn"), "role", "text", "fault", "gone").toDF(*_ROW)


def repair(conversations: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, gone): counts of faults, cost, edits and the repaired text's hash."""
    kind = conversations.schema["conv_id"].dataType
    rows = _keyed(with_faults(conversations)).repartition("key", "no_key").sortWithinPartitions("no_key", "key", "has_turn", "turn", "role", "text")
    done = rows.mapInPandas(_edited(spill_bytes), _OUT)
    return done.select(F.when(~F.col("no_key"), F.col("key")).cast(kind).alias("conv_id"), *[c.split()[0] for c in _OUT.split(", ")[2:]])


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), turn (null for an inserted one), role, text, edit. A second
    pass reads each conversation's edit string before its rows, in the same order."""
    kind = conversations.schema["conv_id"].dataType
    edits = repair(conversations).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("no_key"), F.lit(0).cast("long").alias("turn"), F.lit(False).alias("has_turn"),
                                         F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("fault"), F.lit(False).alias("gone"), F.lit(0).alias("part"))
    rows = _keyed(with_faults(conversations)).where("NOT gone").withColumn("part", F.lit(1))
    both = edits.unionByName(rows).repartition("key", "no_key").sortWithinPartitions("no_key", "key", "part", "has_turn", "turn", "role", "text")

    def apply(frames):
        own, at, state, place = None, 0, 0, 0

        def frame_of(out):
            columns = dict(zip(("key", "no_key", "place", "turn", "role", "text", "edit"), zip(*out)))
            return pd.DataFrame(columns | {"turn": pd.array(columns["turn"], "Int64")})

        def rest(out, row=None):
            """The insertions that stand next, then the row's own edit."""
            nonlocal at, state, place
            while at < len(own[2]) and own[2][at] == "I":
                role, state = NEXT[state]
                out.append((*own[:2], place, None, role, "", "Insert"))
                at, place = at + 1, place + 1
            if row is not None:
                letter, (turn, role, text) = own[2][at], row
                at += 1
                if letter != "D":
                    role, state = (role, KEPT[state, role[:1]]) if letter == "K" else NEXT[state]
                    out.append((*own[:2], place, turn, role, text, "Keep" if letter == "K" else "Rerole"))
                    place += 1

        for frame in frames:
            out = []
            for key, no_key, turn, has_turn, role, text, part in zip(*(frame[c].tolist() for c in ("key", "no_key", "turn", "has_turn", "role", "text", "part"))):
                if part == 0:
                    if own is not None:
                        rest(out)
                    own, at, state, place = (key, no_key, text), 0, 0, 0
                else:
                    rest(out, (turn if has_turn else None, role, text))
            if out:
                yield frame_of(out)
        if own is not None:
            out = []
            rest(out)
            if out:
                yield frame_of(out)

    done = both.mapInPandas(apply, "key string, no_key boolean, place bigint, turn bigint, role string, text string, edit string")
    return done.select(F.when(~F.col("no_key"), F.col("key")).cast(kind).alias("conv_id"), "place", "turn", "role", "text", "edit")


def summary(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' faults and cheapest repair."""
    return repair(damaged(conversations))
