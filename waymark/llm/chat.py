"""Roles of transcript lines by a hidden Markov model, and canonical rendering of turns.

Each line is observed as its speaker marker (user, assistant, system, other, none) and its length
(blank, short, long). Hidden states are the role and whether the line begins a turn. Start, transition
and emission probabilities are counted on transcripts whose roles are known. Viterbi's recursion
is a product of small max-plus matrices, so long transcripts are decoded in blocks: each block
is reduced to one matrix, blocks of blocks likewise, and the best path is then settled from
the top down. No task sees more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut
from .substring import NO_ID

ROLES = ["system", "user", "assistant"]
N_STATES = 2 * len(ROLES) + 1  # role * 2 (begins) or role * 2 + 1 (goes on); the last is "before the first line"
BEFORE = N_STATES - 1
MARKERS = {"user": "user|human|customer|question|q|me", "assistant": "assistant|ai|bot|agent|answer|a|model", "system": "system|instructions?|context"}
_FRAME = r"^[\s>*#\[<(|]{0,4}(?:%s)[\s*\])|>]{0,3}[:>\])|][\s*>]*"
N_OBSERVED = 15
FANOUT = 64
#: Columns of ``transcript_lines`` that give each line its place in its conversation.
PLACE = ("turn", "row", "nth")


def marker_pattern(role: str | None = None) -> str:
    return "(?i)" + _FRAME % (MARKERS[role] if role else "|".join(MARKERS.values()))


def observed(line):
    """Column: the line's observation, marker * 3 + length."""
    marker = F.lit(0)
    for i, role in enumerate(["user", "assistant", "system"], 1):
        marker = F.when(F.regexp_like(line, F.lit(marker_pattern(role))), i).otherwise(marker)
    marker = F.when((marker == 0) & F.regexp_like(line, F.lit(r"^[A-Z][\w .-]{0,20}:\s")), 4).otherwise(marker)
    size = F.when(F.trim(line) == "", 0).when(F.length(line) < 80, 1).otherwise(2)
    return marker * 3 + size


@dataclass
class Hmm:
    transitions: np.ndarray  # (N_STATES, N_STATES) log probabilities
    emissions: np.ndarray  # (N_STATES, N_OBSERVED)

    def step(self, observation: int) -> np.ndarray:
        return self.transitions + self.emissions[None, :, observation]


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        first = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        at = np.arange(len(conv)) - np.repeat(first, np.diff([*first, len(conv)]))
        if conv[0] == last:
            at[: first[1] if len(first) > 1 else len(conv)] += n
        last, n = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])


def numbered(lines: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``lines`` with ``at``: 0, 1, ... within each conv, by the columns ``order``, then by the line.

    Lines are sorted in ranges over all conversations and counted within each; only the conversation that a range
    begins with takes an offset from earlier ones. No task holds a conversation.
    """
    tie = F.xxhash64("line")
    ranges = lines.repartitionByRange("conv", *order, tie).sortWithinPartitions("conv", *order, tie, "line")
    schema = f"{', '.join(f'`{n}` {t}' for n, t in ranges.dtypes)}, at long"
    counted = cut(ranges.mapInArrow(_count_runs, schema).withColumn("part", F.spark_partition_id()))
    ends = counted.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "at")).alias("last")).orderBy("part").collect()
    open_, n, more = None, 0, []
    for r in ends:
        n = n if r["first"] == open_ else 0
        if n:
            more.append((r["part"], r["first"], n))
        n = r["last"]["at"] + 1 + (n if r["last"]["conv"] == r["first"] else 0)
        open_ = r["last"]["conv"]
    offsets = lines.sparkSession.createDataFrame(more, "part int, conv long, more long")
    return counted.join(F.broadcast(offsets), ["part", "conv"], "left").withColumn("at", F.col("at") + F.coalesce("more", F.lit(0))).drop("part", "more")


def train(lines: DataFrame, sample: int = 2000, turns: int = 64) -> Hmm:
    """From labelled lines (conv, turn, row, nth, line, role, begins): those of at most ``sample`` conversations with the
    least hash of the id among those whose crc32(id as text) mod 5 is not 0; of each, the lines of turns below ``turns``."""
    convs = lines.where(~crc_mod("conv", 5).isin(0, -1)).select("conv").distinct()
    convs = convs.orderBy(F.xxhash64("conv"), "conv").limit(sample)
    rows = lines.join(F.broadcast(convs), "conv").where(F.col("turn") < turns)
    index = sum((F.when(F.col("role") == r, 2 * i).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0))
    rows = rows.where(F.col("role").isin(ROLES)).select("conv", *PLACE, "line", (index + F.when(F.col("begins"), 0).otherwise(1)).alias("s"), observed(F.col("line")).alias("o"))
    rows = numbered(rows, PLACE).select("conv", "at", "s", "o")
    before = rows.select("conv", (F.col("at") + 1).alias("at"), F.col("s").alias("b"))
    counts = rows.join(before, ["conv", "at"], "left").fillna(BEFORE, "b").groupBy("b", "s", "o").count().collect()
    trans, emit = np.full((N_STATES, N_STATES), 0.1), np.full((N_STATES, N_OBSERVED), 0.1)
    for r in counts:
        trans[r["b"], r["s"]] += r["count"]
        emit[r["s"], r["o"]] += r["count"]
    trans[:, BEFORE] = 1e-300
    return Hmm(np.log(trans / trans.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True)))


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def settle(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States after each matrix on the best path from ``entry`` to ``leave`` (if -1, to the best last state)."""
    score, back = matrices[0][entry], []
    for m in matrices[1:]:
        both = score[:, None] + m
        back.append(both.argmax(axis=0))
        score = both.max(axis=0)
    path = [int(score.argmax()) if leave < 0 else leave]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _matrices(model: Hmm, items: list) -> list[np.ndarray]:
    if items and items[0]["m"] is None:
        return [model.step(x["o"]) for x in items]
    return [np.array(x["m"]).reshape(N_STATES, N_STATES) for x in items]


def viterbi(lines: DataFrame, model: Hmm, span: int = 256) -> DataFrame:
    """(conv, pos, state) of lines (conv, pos, o): the most likely states of each conversation."""
    empty = F.lit(None).cast("array<double>")
    level = lines.select("conv", "pos", "o", empty.alias("m"))
    levels: list[DataFrame] = []
    while True:
        item = F.struct("pos", "o", "m")
        grouped = level.groupBy("conv", F.expr(f"pos div {span}").alias("up")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        levels.append(grouped)

        def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                m = [product(_matrices(model, list(x))).ravel().tolist() for x in pdf["items"]]
                yield pd.DataFrame({"conv": pdf["conv"], "pos": pdf["up"], "m": m})

        level = cut(grouped.mapInPandas(reduce_, "conv long, pos long, m array<double>"))
        level = level.select("conv", "pos", F.lit(0).alias("o"), "m")
        if (level.agg(F.max("pos")).first()[0] or 0) == 0:
            break
        span = FANOUT
    settled = level.select("conv", F.col("pos").alias("up"), F.lit(BEFORE).alias("entry"), F.lit(-1).alias("leave"))
    for grouped in reversed(levels):

        def settle_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out: tuple[list, ...] = ([], [], [], [])
                for conv, entry, leave, items in zip(pdf["conv"], pdf["entry"], pdf["leave"], pdf["items"], strict=True):
                    items = list(items)
                    path = settle(_matrices(model, items), int(entry), int(leave))
                    for x, a, b in zip(items, [int(entry), *path], path, strict=False):
                        for to, v in zip(out, (conv, x["pos"], a, b), strict=True):
                            to.append(v)
                yield pd.DataFrame(dict(zip(("conv", "up", "entry", "leave"), out, strict=True)))

        both = grouped.join(settled, ["conv", "up"]).select("conv", "entry", "leave", "items")
        settled = both.mapInPandas(settle_, "conv long, up long, entry int, leave int")
    return settled.select("conv", F.col("up").alias("pos"), F.col("leave").alias("state"))


def parse_transcripts(lines: DataFrame, model: Hmm, span: int = 256, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Turns (conv_id, start, role, n_lines, text, rendered) of transcript lines (conv, *order, line) in the order
    of the columns ``order``, then of the lines themselves; ``start`` is the first of these columns at the turn's
    first line, and ``span`` lines are a block. A null conversation id is one conversation of its own; a null line
    is blank; lines equal in every column are one line's repeats and are decoded once, all others are kept; other columns are
    ignored; conversations and turns of any length are handled alike; an empty table gives an empty result."""
    source = lines.select(F.coalesce("conv", F.lit(NO_ID)).alias("conv"), *order, F.coalesce("line", F.lit("")).alias("line")).distinct()
    source = numbered(source, order).select("conv", F.col("at").alias("pos"), F.col(order[0]).alias("first"), "line")
    states = viterbi(source.withColumn("o", observed(F.col("line"))), model, span)
    joined = source.join(states, ["conv", "pos"]).withColumn("block", F.expr(f"pos div {span}"))
    begin = F.when(F.col("state") % 2 == 0, F.col("pos"))
    # A conversation's first line opens its first turn, whatever its state.
    ends = joined.groupBy("conv", "block").agg(F.max(begin).alias("last"), F.min("pos").alias("head"))
    order = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv", "block", F.coalesce(F.last("last", True).over(order), F.first("head").over(order), F.col("head")).alias("before"))
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("own", F.last(begin, True).over(inside)).join(ends, ["conv", "block"])
    placed = placed.withColumn("start", F.coalesce("own", "before"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.min(F.struct("pos", "state"))["state"] / 2).cast("int") + 1)
    turns = placed.groupBy("conv", "start").agg(
        F.min(F.struct("pos", "first"))["first"].alias("first"), role.alias("role"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("raw")
    )
    text = F.regexp_replace(F.regexp_replace("raw", marker_pattern(), ""), r"^\s+|\s+$", "")
    return turns.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), F.col("first").alias("start"), "role", "n_lines", text.alias("text")).withColumn(
        "rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    )


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table of turns (conv_id, turn, role, text): lines (conv, pos, line), with what is
    known of them (turn, role, begins). Each conversation has one of six ways of marking speakers; one turn in
    eight has no marker, only a blank line before it.

    Only rows equal in every column count once. (turn, row, nth) places a line: different rows of one turn follow
    each other by role and a digest of their text. pos, which is turn * 2^20 + nth, places it only where no
    conversation repeats a turn and none has over 2^20 lines. A null turn is turn 0.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text").distinct()
    row = F.concat_ws("/", F.coalesce(F.lower("role"), F.lit("")), F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text"))))
    conv, turn = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.col("turn").cast("long"), F.lit(0))
    c = conversations.select(conv.alias("conv"), turn.alias("turn"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    style = F.crc32(F.col("conv").cast("string")) % 6
    bare = F.crc32(F.concat_ws("/", "conv", "turn")) % 8 == 0
    name = {
        0: F.concat(F.initcap("role"), F.lit(": ")),
        1: F.concat(F.lit("["), "role", F.lit("] ")),
        2: F.concat(F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("Context"), F.lit(": ")),
        3: F.concat(F.lit("**"), F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("System"), F.lit("**: ")),
        4: F.concat(F.lit("<"), "role", F.lit("> ")),
        5: F.concat(F.upper("role"), F.lit("> ")),
    }
    marker = F.when(bare, F.lit("\n"))
    for k, v in name.items():
        marker = marker.when(style == k, v)
    lines = F.posexplode(F.split(F.concat(F.coalesce(marker, F.lit("")), "text"), "\n")).alias("nth", "line")
    return c.select("conv", "turn", "row", "role", lines).select("conv", *PLACE, "role", "line", (F.col("turn") * (1 << 20) + F.col("nth")).alias("pos"), (F.col("nth") == 0).alias("begins"))
