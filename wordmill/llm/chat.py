"""Chat transcripts: a hidden Markov model recovers who speaks in every line, turns are rendered alike.

Hidden states are a role with "begins a turn" or "goes on". A line shows a symbol: which speaker
marker it opens with, if any, how long it is, how it ends and whether it opens its transcript.
Counts over labelled lines give the model; Viterbi decoding recovers the states of all lines of a
transcript together, so lines without a marker take their role from what surrounds them.

All rows are numbered in one total order; 64 numbers of one transcript are a block. What a stretch of
lines does to the scores is a matrix (state before it, or nothing, to state at its end), and matrices of
stretches next to each other multiply (max-plus). Lines give blocks, blocks give groups of blocks, and so
on to whole transcripts; on the way back every stretch is told the states before it and at its end. So a
transcript of any length is decoded as one, and no task holds more than one group's matrices at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for begins in (True, False) for role in ROLES]
#: Names that open a speaker's line, by role.
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "q"), "assistant": ("assistant", "bot", "ai", "a")}
MARKER = r"^\s*[\[<*#]*\s*(?i:{})\s*[\]>*]*\s*[:>]\s*"
SYMBOLS = 4 * 4 * 3 * 2


def marker(names: tuple[str, ...]) -> str:
    return MARKER.format("(?:" + "|".join(names) + ")")


def symbol(line: Column, opens: Column) -> Column:
    """What a line shows, as a number under SYMBOLS."""
    text = F.coalesce(line, F.lit(""))
    spoken = F.lit(0)
    for number, role in enumerate(ROLES, 1):
        spoken = F.when(text.rlike(marker(NAMES[role])), number).otherwise(spoken)
    size = F.length(text)
    length = F.when(size == 0, 0).when(size < 80, 1).when(size < 300, 2).otherwise(3)
    end = F.when(text.rlike(r"\?\s*$"), 2).when(text.rlike(r"[.!]\s*$"), 1).otherwise(0)
    return (((spoken * 4 + length) * 3 + end) * 2 + opens.cast("int")).cast("int")


@dataclass
class Model:
    """Log chances: of the first state (of a beginning role), of steps between states, of symbols."""

    first: np.ndarray
    steps: np.ndarray
    shows: np.ndarray


def fit(lines: DataFrame) -> Model:
    """A model from labelled lines (run, pos, opens, line, role, begins): three counts, each of fixed size.

    Lines of other or null roles teach nothing. Steps count within runs.
    """
    state = F.lit(None).cast("int")
    for number, (role, begins) in enumerate(STATES):
        state = F.when((F.col("role") == role) & (F.col("begins") == begins), number).otherwise(state)
    by = Window.partitionBy("run").orderBy("pos")
    seen = lines.withColumn("state", state).withColumn("before", F.lag("state").over(by))
    counts = written(
        seen.where("state is not null").groupBy("state", "before", symbol(F.col("line"), F.col("opens")).alias("symbol"), "opens").agg(F.count("*").alias("n")),
        "chat-counts",
    ).collect()  # states x states x symbols at most
    k = len(STATES)
    first, steps, shows = np.full(k, 0.5), np.full((k, k), 0.5), np.full((k, SYMBOLS), 0.05)
    for r in counts:
        shows[r["state"], r["symbol"]] += r["n"]
        if r["before"] is not None:
            steps[r["before"], r["state"]] += r["n"]
        if r["opens"]:
            first[r["state"]] += r["n"]
    for number, (role, begins) in enumerate(STATES):
        if not begins:
            first[number] = 0
            for other, (other_role, _) in enumerate(STATES):
                if other_role != role:
                    steps[other, number] = 0  # nobody goes on with another's turn
    with np.errstate(divide="ignore"):
        return Model(np.log(first / first.sum()), np.log(steps / steps.sum(axis=1, keepdims=True)), np.log(shows / shows.sum(axis=1, keepdims=True)))


def line_matrices(model: Model) -> np.ndarray:
    """(symbols, states + 1, states): best scores from each state before a line (the last row: nothing) to each at the line."""
    entry = np.concatenate([model.steps, model.first[None]])
    return entry[None] + model.shows.T[:, None, :]


def combined(matrices: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, states + 1, states) products of n padded sequences (n, length, states + 1, states) of matrices."""
    out = matrices[:, 0]
    for t in range(1, matrices.shape[1]):
        live = sizes > t
        out[live] = (out[live][:, :, :, None] + matrices[live, t, None, :-1]).max(axis=2)
    return out


def traced(matrices: np.ndarray, sizes: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, length) best states at the end of every member of n padded sequences, between the states before (-1: nothing) and at the end.

    Of equally good states the first wins.
    """
    n, length = matrices.shape[:2]
    each = np.arange(n)
    ahead = [matrices[each, 0, before]]
    for t in range(1, length):
        ahead.append((ahead[-1][:, :, None] + matrices[:, t, :-1]).max(axis=1))
    out = np.repeat(end[:, None], length, axis=1)
    for t in range(length - 1, 0, -1):
        found = (ahead[t - 1] + matrices[each, t, :-1, out[:, t]]).argmax(axis=1)
        out[:, t - 1] = np.where(sizes > t, found, out[:, t - 1])
    return out


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole groups with equal keys and the groups' sizes, from batches of sorted rows."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), dtype=bool)
        for key in keys:
            values = batch[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
            new[0] |= bool(rest) and rest[-1][key].iloc[-1] != values[0]
        starts = np.flatnonzero(new)
        if not len(starts):
            rest.append(batch)
            continue
        yield from _sized(pd.concat([*rest, batch.iloc[: starts[-1]]]) if rest or starts[-1] else batch.iloc[:0], keys)
        rest = [batch.iloc[starts[-1] :]]
    if rest:
        yield from _sized(pd.concat(rest), keys)


def _sized(rows: pd.DataFrame, keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    if len(rows):
        change = np.zeros(len(rows), dtype=bool)
        for key in keys:
            values = rows[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        yield rows, np.diff(np.append(starts, len(rows)))


def _padded(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows): groups of like sizes together, and the places (groups, longest) of their rows; CELLS_AT_ONCE or one group at a time."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] * (end + 1 - at) <= CELLS_AT_ONCE and sizes[order[end]] <= 2 * sizes[order[at]]:
            end += 1
        own = order[at:end]
        yield own, starts[own][:, None] + np.minimum(np.arange(sizes[own].max())[None, :], sizes[own][:, None] - 1)
        at = end


K = len(STATES)


def _unpacked(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs)).reshape(-1, K + 1, K)


def _products(rows: DataFrame, keys: list[str], order: str, matrices) -> DataFrame:
    """(keys..., scores): the product of the matrices of every group of rows."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sizes in _groups(batches, keys):
            every = matrices(part)
            out = np.empty((len(sizes), K + 1, K))
            for own, places in _padded(sizes):
                out[own] = combined(every[places], sizes[own])
            firsts = part.iloc[np.cumsum(sizes) - sizes]
            yield firsts[keys].assign(scores=[m.tobytes() for m in out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, f"{kinds}, scores binary")


def _told(rows: DataFrame, keys: list[str], order: str, matrices, passed: list[str]) -> DataFrame:
    """(passed..., before, end) of every row, from rows with their group's states g_before and g_end."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in passed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sizes in _groups(batches, keys):
            every, ends, before = matrices(part), np.empty(len(part), dtype=np.int32), np.empty(len(part), dtype=np.int32)
            starts = np.cumsum(sizes) - sizes
            g_before, g_end = part["g_before"].to_numpy()[starts], part["g_end"].to_numpy()[starts]
            for own, places in _padded(sizes):
                ends[places] = traced(every[places], sizes[own], g_before[own], g_end[own])
            before[1:] = ends[:-1]
            before[starts] = g_before
            yield part[passed].assign(before=before, end=ends)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, f"{kinds}, before int, end int")


def speakers(lines: DataFrame, model: Model, rows: int) -> DataFrame:
    """(run, pos, role, begins, first_pos) for lines (conv, run, pos, opens, line), rows being the number of all rows.

    first_pos is where the line's turn begins, or its run if the turn goes on from the run before.
    """
    tables = line_matrices(model)

    def of_lines(part: pd.DataFrame) -> np.ndarray:
        return tables[part["symbol"].to_numpy()]

    def of_groups(part: pd.DataFrame) -> np.ndarray:
        return _unpacked(part["scores"])

    shown = written(lines.select("conv", "run", "pos", symbol(F.col("line"), F.col("opens")).alias("symbol")), "chat-symbols")
    levels = [written(_products(shown, ["conv", "run"], "pos", of_lines).withColumnRenamed("run", "g0"), "chat-scores")]
    shift = BLOCK_BITS
    while rows >> shift:  # one group of GROUP_BITS more at a time, until a transcript is one
        shift += GROUP_BITS
        own, above = f"g{len(levels) - 1}", f"g{len(levels)}"
        levels[-1] = levels[-1].withColumn(above, F.shiftright(own, shift))
        levels.append(written(_products(levels[-1], ["conv", above], own, of_groups), "chat-scores"))
    top = levels.pop()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="scores").assign(before=-1, end=_unpacked(batch["scores"])[:, -1].argmax(axis=1))

    name = top.columns[1]
    told = top.mapInPandas(ends, f"conv string, {name} bigint, before int, end int")
    while levels:
        rows_ = levels.pop()
        known = rows_.join(told.withColumnsRenamed({"before": "g_before", "end": "g_end"}), ["conv", name])
        own = rows_.columns[1]
        told = _told(known, ["conv", name], own, of_groups, ["conv", own])
        name = own
    told = told.withColumnsRenamed({"before": "g_before", "end": "g_end", name: "run"}).drop("conv")
    states = _told(shown.select("run", "pos", "symbol").join(told, "run"), ["run"], "pos", of_lines, ["run", "pos"])
    role, begins = (F.get(F.array(*(F.lit(s[i]) for s in STATES)), F.col("end")) for i in (0, 1))
    by = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce(F.max(F.when(F.col("begins"), F.col("pos"))).over(by), F.min("pos").over(by))
    return states.select("run", "pos", role.alias("role"), begins.alias("begins")).withColumn("first_pos", first)


def turns(spoken: DataFrame) -> DataFrame:
    """(conv, first_pos, turn, role, n_lines, rendered): one row per recovered turn, in one canonical form without markers.

    spoken holds conv, turn, pos, line, role, begins, first_pos. A turn that goes on from one block into
    the next is rendered in a part for each, so that no turn outgrows a block.
    """
    every = "(?:" + "|".join(n for names in NAMES.values() for n in names) + ")"
    bare = F.when(F.col("begins"), F.regexp_replace("line", MARKER.format(every), "")).otherwise(F.col("line"))
    grouped = spoken.withColumn("bare", F.coalesce(bare, F.lit(""))).groupBy("conv", "first_pos", "role").agg(
        F.min_by("turn", "pos").alias("turn"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", "bare"))).alias("l")
    )
    body = F.array_join(F.transform("l", lambda x: x["bare"]), "\n")
    return grouped.select("conv", "first_pos", "turn", "role", "n_lines", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), body, F.lit("<|im_end|>")).alias("rendered"))


#: Rows in a block at most, blocks in a group, lines in a row, as powers of two, and padded cells at once.
BLOCK_BITS, GROUP_BITS, LINE_BITS = 6, 10, 24
CELLS_AT_ONCE = 50_000


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv, number, run, pos, opens, line, role, begins, held_out, turn): rows of conversations as transcript lines.

    Three of four turns, by a hash, open with one of their role's names; the others show nothing. role
    and begins are the truth, held_out is that the crc32 of the id as text leaves 1 when divided by 3.
    Null ids are one conversation; null texts are empty lines; null turns count as 0.

    Rows of one turn follow each other by a hash of their text; equal rows are a turn each. number is
    the row's place in this order of all rows; it depends on the rows alone, not on their partitioning.
    run names the row's block by its first row, pos is number and line within the row, and opens
    marks the first line of a conversation. A very long text is as many lines as it has, to 2^24.
    """
    turn = F.coalesce(F.col("turn"), F.lit(0)).cast("bigint")
    pick = F.xxhash64("conv_id", "turn", "text")
    name = F.lit(None).cast("string")
    for role, names in NAMES.items():
        name = F.when(F.col("role") == role, F.get(F.array(*(F.lit(n.title()) for n in names)), F.pmod(pick, F.lit(len(names))).cast("int"))).otherwise(name)
    shown = F.when(F.pmod(F.shiftright(pick, 8), F.lit(4)) > 0, F.concat(name, F.lit(": "))).otherwise(F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), turn.alias("turn"), F.col("role").alias("role"),
        F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.concat(F.coalesce(shown, F.lit("")), F.coalesce("text", F.lit(""))).alias("said"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    ordered = rows.orderBy("conv", "turn", "hash", "said", "role", "row")  # row only lets many equal rows go to several parts
    placed = written(ordered.select("conv", "turn", "role", "held_out", "said", F.monotonically_increasing_id().alias("place")), "chat-rows")
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each sorted part
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = conversations.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "part bigint, start bigint")
    numbered = placed.join(F.broadcast(offsets), part == F.col("part")).drop("part")  # one row for each sorted part
    numbered = numbered.withColumn("number", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("block", F.shiftright("number", BLOCK_BITS))
    first = numbered.groupBy("conv").agg(F.min("number").alias("first")).withColumn("block", F.shiftright("first", BLOCK_BITS))
    lines = numbered.join(first, ["conv", "block"], "left").select(
        "conv", "number", F.coalesce("first", F.shiftleft("block", BLOCK_BITS)).alias("run"), F.coalesce(F.col("number") == F.col("first"), F.lit(False)).alias("opening"),
        "role", "held_out", "turn", F.posexplode(F.split("said", "\n")).alias("at", "line"),
    )
    return lines.select(
        "conv", "number", "run", (F.shiftleft("number", LINE_BITS) + F.col("at")).alias("pos"), (F.col("opening") & (F.col("at") == 0)).alias("opens"),
        "line", "role", (F.col("at") == 0).alias("begins"), "held_out", "turn",
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id as text, first_line, turn, role, n_lines, rendered) of every turn recovered from the transcripts of conversations.

    The model is fitted on lines that are not held out. turn is the number of the turn that the
    recovered one starts in, first_line the place of its first line in that turn's row. Cases are those of
    transcripts(); extra columns are not read.
    """
    lines = written(transcripts(conversations), "chat-transcripts")
    model = fit(lines.where(~F.col("held_out")))
    rows = (lines.agg(F.max("number")).first()[0] or 0) + 1
    found = speakers(lines, model, rows)
    spoken = lines.select("conv", "turn", "run", "pos", "line").join(found, ["run", "pos"])
    return turns(spoken).select(F.col("conv").alias("conv_id"), F.pmod("first_pos", F.lit(1 << LINE_BITS)).alias("first_line"), "turn", "role", "n_lines", "rendered")
