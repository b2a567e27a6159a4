"""Repair of the order of roles in conversations, by dynamic programming over secondary-sorted streams.

Rows are dealt by conversation and sorted by turn; one pass of mapInPandas carries the state of the conversation at hand from
batch to batch. An automaton of four states (nothing yet, after a system row, after a user row, after an assistant
row) reads the repaired roles; at each row and state the pass keeps the least cost and the order of the least edit scripts. There
are only a few such configurations, since states that cost more than another one's way around them are dropped, so each
row is one look-up. In a given state only one of user and assistant can follow, so the script says it all.

For every row four 6-bit backpointers are kept. Conversations of more than a block of rows or text write each block's backpointers
out as a row of the result and drop its texts (digests of the at most four live repairs are carried on); a second pass over
these rows, last block first, follows them back. So memory is bounded by a block, whatever the size of a conversation.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The costs of edits and of a truncated row that stays.
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
EDITS = "DIKR"
D, I, K, R = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial.
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after, and role of, a row that is inserted or gets a new role.
NEXT = [USER, USER, ASSISTANT, USER]
NAMES = ["user", "user", "assistant", "user"]
#: What it costs at most more to go on from the first state as one would from the second.
AROUND = {
    (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT, (ASSISTANT, NOTHING): DELETE, (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, NOTHING): INSERT + DELETE,
    (NOTHING, SYSTEM): 0, (NOTHING, ASSISTANT): 0, (NOTHING, USER): INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
}
#: Kinds of rows: initial (s, u, a, other) times 2, plus 1 if truncated; the last must go.
GOES = 8
#: Rows and characters of a block.
BLOCK, BLOCK_CHARS = 1 << 15, 1 << 20
NOT_BLANK = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"

#: Costs above the least one and places in the order of scripts, by state; None for states out of use.
Config = tuple[tuple[int, int] | None, ...]
START: Config = ((0, 0), None, None, None)


@cache
def step(config: Config, kind: int) -> tuple[Config, int, int]:
    """(configuration, cost, backpointers) after a row. A backpointer is state before | inserts << 2 | edit << 4."""
    best: dict[int, tuple] = {}
    for source, known in enumerate(config):
        if known is None:
            continue
        state = source
        for inserts in range(3):
            ways = [(D, state, DELETE)]
            if kind != GOES:
                late = TRUNCATED * (kind & 1)
                ways.append((R, NEXT[state], REROLE + late))
                kept = AFTER.get((state, "sua-"[kind >> 1]))
                if kept is not None:
                    ways.append((K, kept, late))
            for edit, to, cost in ways:
                way = (known[0] + INSERT * inserts + cost, known[1], "I" * inserts + EDITS[edit], source | inserts << 2 | edit << 4)
                if to not in best or way < best[to]:
                    best[to] = way
            state = NEXT[state]
    for (one, other), more in AROUND.items():
        if one in best and other in best and best[one][0] + more < best[other][0]:
            best[other] = (*best[other][:3], -1)  # dropped, but still a way around
    best = {q: way for q, way in best.items() if way[3] >= 0}
    least = min(way[0] for way in best.values())
    order = sorted(best, key=lambda q: best[q][1:3])
    pointers = sum(way[3] << 6 * q for q, way in best.items())
    return tuple((best[q][0] - least, order.index(q)) if q in best else None for q in range(4)), least, pointers


def finish(config: Config) -> tuple[int, int, int]:
    """(state, inserts, cost) of the cheapest end, of the least script."""
    ends = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    cost, _, inserts, state = min((known[0] + INSERT * ends[q], known[1], ends[q], q) for q, known in enumerate(config) if known is not None)
    return state, inserts, cost


def back(pointers: array, state: int) -> tuple[int, list[int]]:
    """State before the rows, and each row's backpointer on the way to ``state``."""
    way = []
    for p in reversed(pointers):
        own = p >> 6 * state & 63
        way.append(own)
        state = own & 3
    way.reverse()
    return state, way


def script(way: list[int]) -> str:
    return "".join("I" * (p >> 2 & 3) + EDITS[p >> 4] for p in way)


def _repaired(way: list[int], state: int, roles: list[str], texts: list[str]) -> tuple[str, int]:
    """What the rows add to the repaired conversation, and the state after them."""
    out: list[str] = []
    for p, role, text in zip(way, roles, texts, strict=True):
        for _ in range(p >> 2 & 3):
            out += ["" if state == NOTHING else "\n", NAMES[state], ":"]
            state = NEXT[state]
        edit = p >> 4
        if edit != D:
            out += ["" if state == NOTHING else "\n", role if edit == K else NAMES[state], ":", text]
            state = AFTER[state, role[0]] if edit == K else NEXT[state]
    return "".join(out), state


class Conversation:
    """One conversation as its rows come."""

    def __init__(self, conv_id):
        self.conv_id, self.config, self.cost, self.block = conv_id, START, 0, 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.initial: str | None = None
        self.least = self.last = None
        self.turns = 0
        self.digests = {NOTHING: hashlib.sha256()}
        self._clear()

    def _clear(self) -> None:
        self.pointers, self.roles, self.texts, self.chars = array("I"), [], [], 0

    def add(self, turn: int | None, role: str, text: str, fault: int, kind: int) -> None:
        if fault:
            self.counts[fault - 1] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last = turn
            self.turns += 1
        self.config, cost, pointers = step(self.config, kind)
        self.cost += cost
        self.pointers.append(pointers)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def full(self) -> bool:
        return len(self.pointers) >= BLOCK or self.chars >= BLOCK_CHARS

    def spill(self) -> dict:
        """The block's backpointers as a row; the digests of the live repairs move on."""
        digests = {}
        for state, known in enumerate(self.config):
            if known is not None:
                digests[state] = self._digest(state)[0]
        self.digests = digests
        out = {"conv_id": self.conv_id, "block": self.block, "pointers": self.pointers.tobytes()}
        self.block += 1
        self._clear()
        return out

    def _digest(self, state: int):
        before, way = back(self.pointers, state)
        added, _ = _repaired(way, before, self.roles, self.texts)
        digest = self.digests[before].copy()
        digest.update(added.encode())
        return digest, way

    def rows(self) -> list[dict]:
        """The result, and if blocks were written the last one with the state at its end."""
        state, inserts, more = finish(self.config)
        digest, way = self._digest(state)
        tail, at = "", state
        for _ in range(inserts):
            tail += ("" if at == NOTHING else "\n") + NAMES[at] + ":"
            at = NEXT[at]
        digest.update(tail.encode())
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        blank, duplicate, truncated, illegal = self.counts
        out = {
            "conv_id": self.conv_id, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
            "cost": self.cost + more, "repaired_sha256": digest.hexdigest(), "tail": "I" * inserts,
        }
        if not self.block:
            return [out | {"audit": script(way) + "I" * inserts}]
        return [out, self.spill() | {"state": state}]


def _stream():
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "tail", "block", "pointers", "state"]
    whole = {"gaps", "blank", "duplicate", "truncated", "illegal", "cost", "block", "state"}
    types = {"audit": "string", "repaired_sha256": "string", "tail": "string", "pointers": "binary", "conv_id": "string"}
    schema = ", ".join(f"{n} {'long' if n in whole else types[n]}" for n in names)

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.array([r.get(n) for r in rows], dtype="Int64") if n in whole else pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, out = None, []
        for frame in frames:
            columns = ("conv_id", "present", "has_turn", "turn", "role", "text", "fault", "kind")
            for conv_id, present, known, turn, role, text, fault, kind in zip(*(frame[c].tolist() for c in columns), strict=True):
                if own is None or conv_id != own.conv_id:
                    if own is not None:
                        out += own.rows()
                    own = Conversation(conv_id)
                if present:
                    own.add(turn if known else None, role, text, fault, kind)
                    if own.full():
                        out.append(own.spill())
                        yield table(out)
                        out = []
            if out:
                yield table(out)
                out = []
        if own is not None:
            yield table(out + own.rows())

    return run, schema


def _marked(rows: DataFrame, present: Column) -> DataFrame:
    """Rows with their first fault (1 blank, 2 duplicate, 3 truncated, 0 none) and kind, dealt by conversation and in order. The
    rows are shuffled once: earlier rows of equal role and text are counted within the same partitions."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce(present, F.lit(False)).alias("present"))
    dealt = own.repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn")) > 1
    ends = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(~F.regexp_like("text", F.lit(NOT_BLANK)), 1).when(earlier, 2).when(~ends.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1
    kind = F.when(F.col("fault").isin(1, 2), GOES).otherwise(F.when((initial < 0) | (F.col("role") == ""), 3).otherwise(initial) * 2 + (F.col("fault") == 3).cast("int"))
    marked = dealt.withColumn("fault", fault).withColumn("kind", kind).withColumn("has_turn", F.col("turn").isNotNull())
    return marked.withColumn("turn", F.coalesce("turn", F.lit(0))).sortWithinPartitions("conv_id", "has_turn", "turn", "role", "text")


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scripts of blocks that come last block first, conversation by conversation."""
    state = NOTHING
    for frame in frames:
        scripts = []
        for own, end in zip(frame["pointers"], frame["end"], strict=True):
            if end >= 0:
                state = int(end)
            state, way = back(array("I", bytes(own)), state)
            scripts.append(script(way))
        yield frame[["conv_id", "block"]].assign(audit=scripts)


def repair_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows (conv_id,
    turn, role, text), in order of turn, nulls first, then role and text. ``present`` is false for rows that count for nothing but that
    their conversation is in the result.

    A row's first fault counts: blank, duplicate (of an earlier row's role and text), truncated (its last character that is not white
    is none of ``.!?``). The cheapest edits make the initials of the roles an optional s and then pairs of u and a, or nothing:
    Keep, Rerole, Delete (blank and duplicate rows must go) and Insert of an empty row; ``audit`` holds their initials, of equally
    cheap ones the least in ASCII. ``repaired_sha256`` is the digest of the repaired rows as ``role:text``, joined by line ends.

    A null role or text is one space; null turns come first and count for no gap; all rows without conv_id are one conversation. Rows of
    one turn are ordered by role and text; an empty role fits nowhere. An empty table gives an empty result; other columns are
    ignored. The digest of a conversation is sequential, so its rows pass through one task, a block at a time.
    """
    run, schema = _stream()
    marked = _marked(rows.withColumn("__present", F.lit(True) if present is None else present), F.col("__present"))
    out = written(marked.mapInPandas(run, schema), "repairs")
    blocks = out.where("pointers is not null").select("conv_id", "block", "pointers", F.coalesce("state", F.lit(-1)).alias("end"))
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    followed = ordered.mapInPandas(_follow, "conv_id string, block long, audit string")
    scripts = followed.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("__long"))
    done = out.where("pointers is null")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    short = done.where("audit is not null").select(columns)
    long = done.where("audit is null").join(scripts.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")))
    both = short.unionByName(long.withColumn("audit", F.concat("__long", "tail")).select(columns))
    return both.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations, places from 1 on, from the rows that were repaired (all
    present) and their audits. The order of rows is that of ``repair_conversations``."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").alias("__id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    given = own.withColumn("__row", F.row_number().over(Window.partitionBy("__id").orderBy("turn", "role", "text")))
    letters = repairs.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where(F.col("edit") != "")
    order = Window.partitionBy("conv_id").orderBy("at")
    n = F.count_if(F.col("edit") != "D").over(Window.partitionBy("conv_id"))
    placed = letters.select("conv_id", "edit", F.count_if(F.col("edit") != "I").over(order).alias("__row"), F.count_if(F.col("edit") != "D").over(order).alias("place"), n.alias("n"))
    # With an odd number of rows the first is a system row, so users have the even places, else the odd ones.
    made = F.when(F.col("place") % 2 == F.col("n") % 2, "assistant").otherwise("user")
    kept = placed.where("edit <> 'D'").join(given, F.col("conv_id").eqNullSafe(F.col("__id")) & (placed["__row"] == given["__row"]) & (F.col("edit") != "I"), "left")
    return kept.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (``present`` is false), 1
    empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    own = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), way.alias("way"))
    hurt = own.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") != 0).alias("present"), "way")
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", "role", "text", "present", F.explode(copies).alias("copy")).drop("copy")
