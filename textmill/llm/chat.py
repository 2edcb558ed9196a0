"""Chat formatting with minimum-cost role repair.

Legal conversations are: an optional system turn, then user and assistant by turns, ending with the assistant. Each turn is
kept, merged into the one before it (same role), relabelled, or preceded by empty turns (between two of the same role, too);
dynamic programming over the automaton's states finds the repair of least total cost, ties by the order of the states, and a
merge before insertions of the same cost. The repaired turns are rendered piece by piece: a conversation's pieces, joined in
order, are its text.

Conversations are cut into segments of at most ``Config.segment`` turns, and where a sort by range cuts them, so one of any
length is spread over tasks. A segment's costs from each state to each state are a small matrix; per conversation the
matrices, not the turns, are combined.

Defined results: turns are ordered by turn, then role and text, nulls first; a null or unknown role must be relabelled; a null
text is empty; equal rows are separate turns; a null conv_id is a conversation of its own; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import cut, release

ROLES = ("system", "user", "assistant")
#: State 0 is the start; state i + 1 is after a turn of ROLES[i]. What may follow what:
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Config:
    merge: int = 1
    relabel: int = 2
    insert: int = 3
    segment: int = 4096
    begin: str = "<|im_start|>{role}\n"
    end: str = "<|im_end|>\n"
    join: str = "\n"


def fills(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest states to pass from a to b by inserted turns, of a new turn if a is b; None if there are none."""
    if b in NEXT[a]:
        return ()
    ways = [(a, ())]
    for _ in range(3):
        ways = [(s, (*path, s)) for at, path in ways for s in NEXT[at]]
        for at, path in ways:
            if b in NEXT[at]:
                return path
    return None


STEPS = {(a, b): fills(a, b) for a in range(4) for b in range(1, 4)}
LAST = {a: () if a == 3 else (*fills(a, 3), 3) for a in range(4)}


def costs(role: str | None, cfg: Config) -> np.ndarray:
    """(state before, state after) cost of one turn."""
    out = np.full((4, 4), FAR, dtype=np.int64)
    for b in range(1, 4):
        own = 0 if role == ROLES[b - 1] else cfg.relabel
        for a in range(4):
            if STEPS[a, b] is not None:
                out[a, b] = own + cfg.insert * len(STEPS[a, b])
            if a == b:
                out[a, b] = min(out[a, b], own + cfg.merge)
    return out


def merges(a: int, b: int, cfg: Config) -> bool:
    """Whether a turn that leads from a to b joins the one before it."""
    return a == b and (STEPS[a, b] is None or cfg.merge <= cfg.insert * len(STEPS[a, b]))


def segment_matrix(roles: list[str | None], cfg: Config) -> np.ndarray:
    """Least cost from each state before the turns to each after them."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    known = {}
    for r in roles:
        c = known.get(r)
        if c is None:
            c = known[r] = costs(r, cfg)
        total = np.minimum((total[:, :, None] + c[None]).min(1), FAR)
    return total


def path(matrices: list[np.ndarray], start: int, ends: np.ndarray) -> list[int]:
    """The states after each step on the cheapest way from ``start``; ends: cost of ending in each state."""
    best = np.where(np.arange(4) == start, 0, FAR).astype(np.int64)
    back = []
    for m in matrices:
        way = best[:, None] + m
        back.append(way.argmin(0))
        best = np.minimum(way.min(0), FAR)
    at = int((best + ends).argmin())
    out = []
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return out[::-1]


def repair(roles: list[str | None], start: int, end: int | None, cfg: Config) -> list[int]:
    """The state after each turn; ``end`` None: of a whole conversation, which is closed with the assistant."""
    ends = np.array([cfg.insert * len(LAST[a]) for a in range(4)]) if end is None else np.where(np.arange(4) == end, 0, FAR)
    known: dict = {}
    return path([known.setdefault(r, costs(r, cfg)) for r in roles], start, ends)


def pieces(roles: list[str | None], texts: list[str | None], states: list[int], start: int, last: bool, cfg: Config) -> list[dict]:
    """Of each turn what was done and its part of the rendered text."""
    name = lambda s: ROLES[s - 1]
    empty = lambda ss: "".join(cfg.begin.format(role=name(s)) + cfg.end for s in ss)
    out = []
    at = start
    for i, (r, t, s) in enumerate(zip(roles, texts, states)):
        joined = merges(at, s, cfg)
        filled = () if joined else STEPS[at, s]
        if joined:
            text = cfg.join + (t or "")
        else:
            text = (cfg.end if at else "") + empty(filled) + cfg.begin.format(role=name(s)) + (t or "")
        after: tuple[int, ...] = ()
        if last and i == len(roles) - 1:
            after = LAST[s]
            text += cfg.end + empty(after)
        action = "merge" if joined else "keep"
        if r != name(s):
            action = "relabel" if action == "keep" else "relabel,merge"
        out.append({"new_role": name(s), "action": action, "inserted_before": [name(x) for x in filled], "inserted_after": [name(x) for x in after], "rendered": text})
        at = s
    return out


def format_chats(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per turn of ``turns`` (conv_id, turn, role, text): conv_id, turn, pos (order in the conversation), role, new_role, action, inserted_before,
    inserted_after and rendered."""
    rows = turns.select("conv_id", "turn", "role", F.col("text"))
    # the row's place lets a range cut between equal rows
    placed = cut(rows.withColumn("at", F.monotonically_increasing_id()), "placed")
    ordered = placed.repartitionByRange("conv_id", "turn", "role", "text", "at").sortWithinPartitions("conv_id", "turn", "role", "text", "at").drop("at")
    made = cut(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")
    release(placed)
    made = made.withColumn("part", F.expr(f"pos div {cfg.segment}"))  # of places that go on within a partition, so of one partition each
    turn = F.struct("pos", "turn", "role", "text")
    segs = made.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("t"))  # at most ``segment`` turns

    @F.pandas_udf("array<long>")
    def matrix(roles: pd.Series) -> pd.Series:
        return pd.Series([segment_matrix(list(r), cfg).ravel().tolist() for r in roles])

    @F.pandas_udf("array<int>")
    def states(ms: pd.Series) -> pd.Series:
        ends = np.array([cfg.insert * len(LAST[a]) for a in range(4)])
        return pd.Series([path([np.array(m).reshape(4, 4) for m in some], 0, ends) for some in ms])

    costs_of = cut(segs.select("conv_id", "part", matrix(F.col("t.role")).alias("m")), "costs")
    per = costs_of.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("s")).withColumn("e", states(F.col("s.m")))
    way = per.select("conv_id", F.posexplode(F.arrays_zip(F.col("s.part").alias("part"), F.col("e").alias("end"))).alias("i", "x"), F.size("s").alias("n"), "e")
    way = way.select(F.col("conv_id").alias("c"), F.col("x.part").alias("p"), F.when(F.col("i") > 0, F.get("e", F.col("i") - 1)).otherwise(0).alias("start"), F.col("x.end").alias("end"), (F.col("i") + 1 == F.col("n")).alias("last"))

    kind = "array<struct<new_role:string,action:string,inserted_before:array<string>,inserted_after:array<string>,rendered:string>>"

    @F.pandas_udf(kind)
    def render(roles: pd.Series, texts: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for r, t, a, b, z in zip(roles, texts, start, end, last):
            r, t = list(r), list(t)
            out.append(pieces(r, t, repair(r, int(a), int(b), cfg), int(a), bool(z), cfg))
        return pd.Series(out)

    both = segs.join(way, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    done = both.select("conv_id", F.explode(F.arrays_zip(F.col("t"), render(F.col("t.role"), F.col("t.text"), "start", "end", "last").alias("r"))).alias("x"))
    return done.select("conv_id", "x.t.turn", "x.t.pos", "x.t.role", "x.r.new_role", "x.r.action", "x.r.inserted_before", "x.r.inserted_after", "x.r.rendered")


def rendered(turns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """conv_id and text: each conversation's pieces joined. For conversations that fit a row; ``format_chats`` has no such bound."""
    p = format_chats(turns, cfg).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rendered"))).alias("p"))
    return p.select("conv_id", F.array_join(F.col("p.rendered"), "").alias("text"))
