"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant last. Dynamic programming over the
automaton of legal turns finds the cheapest repair of each conversation: a turn keeps its role or is relabelled,
opens a new turn or is merged into the previous one of its role, and empty turns are inserted where one is missing.
The repaired turns are rendered with role headers.

Steps through the automaton compose, so a long conversation is cut in pieces of ``piece`` turns: each piece gives the
least cost between each pair of states, the pieces' costs give the states at the cuts, and each piece is then
repaired on its own. No task holds more of a conversation than one piece and a small matrix per piece.

Roles are compared trimmed and lower-cased; null and unknown roles must be relabelled. Null texts render empty. Turns are ordered by turn
number (nulls first), then role and text; repeated rows are turns of their own. Rows with a null conv_id form one conversation.
Among repairs of equal cost a turn prefers its own role, then to open a turn, then the earlier state. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import placed, running_sums, unplaced
from ..operators.rounds import Rounds
from .common import Scratch, map_exact

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
# Legal next states, and the turns to insert before a label that is not legal yet.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MISSING = {(START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,)}
# Turns to insert at the end.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
NEVER = np.inf


def options(role: int | None) -> dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]:
    """(from, to) -> cheapest (cost, action, inserted turns) for a turn of the given role."""
    out: dict[tuple[int, int], tuple[float, str, tuple[int, ...]]] = {}
    for q in range(4):
        for label in (SYSTEM, USER, ASSISTANT):
            own = label == role
            base, name = (0.0, "keep") if own else (RELABEL, "relabel")
            ways = []
            if label in NEXT[q]:
                ways.append((base, name, ()))
            if label == q:
                ways.append((base + MERGE, "merge" if own else "relabel_merge", ()))
            if (q, label) in MISSING:
                ways.append((base + INSERT * len(MISSING[q, label]), name, MISSING[q, label]))
            if ways:
                best = min(ways, key=lambda w: w[0])
                out[q, label] = best
    return out


OPTIONS = {role: options(role) for role in (None, SYSTEM, USER, ASSISTANT)}
COSTS = {role: np.array([[OPTIONS[role].get((q, p), (NEVER,))[0] for p in range(4)] for q in range(4)]) for role in OPTIONS}
END = np.array([INSERT * len(ENDING[q]) for q in range(4)])


def role_of(role: str | None) -> int | None:
    name = role.strip().lower() if isinstance(role, str) else None
    return ROLES.index(name) + 1 if name in ROLES else None


def least_costs(roles: list[int | None]) -> np.ndarray:
    """Least cost from each state to each state over a run of turns."""
    out = np.where(np.eye(4, dtype=bool), 0.0, NEVER)
    for r in roles:
        out = (out[:, :, None] + COSTS[r][None]).min(axis=1)
    return out


def best_states(roles: list[int | None], first: int, last: int) -> list[int]:
    """States after each turn on a cheapest way from ``first`` to ``last``."""
    cost = np.full(4, NEVER)
    cost[first] = 0
    back = []
    for r in roles:
        ways = cost[:, None] + COSTS[r]
        back.append(ways.argmin(axis=0))
        cost = ways.min(axis=0)
    out = [last]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def header(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


def repaired(roles: list[int | None], texts: list[str | None], first: int, last: int, closes: bool) -> list[tuple[str, str, int, str]]:
    """(new role, action, inserted turns, rendered text) of each turn of a piece."""
    out, q = [], first
    for r, text, p in zip(roles, texts, best_states(roles, first, last), strict=True):
        _, action, inserted = OPTIONS[r][q, p]
        text = text or ""
        if action.endswith("merge"):
            shown = f"\n{text}"
        else:
            shown = "".join(f"{header(i)}<|end|>\n" for i in inserted) + header(p) + text
            shown = f"<|end|>\n{shown}" if q != START else shown
        out.append([ROLES[p - 1], action, len(inserted), shown])
        q = p
    if closes and out:
        out[-1][2] += len(ENDING[q])
        out[-1][3] += "<|end|>\n" + "".join(f"{header(i)}<|end|>\n" for i in ENDING[q])
    return [tuple(x) for x in out]


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal keys over sorted frames."""

    def rows():
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            yield from frame.itertuples(index=False)

    return groupby(rows(), key=lambda r: tuple(getattr(r, k) for k in keys))


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for (conv, piece), turns in _grouped(frames, ["conv", "piece"]):
        rows.append((conv, piece, least_costs([role_of(t.role) for t in turns]).ravel()))
        if len(rows) >= 2000:
            yield pd.DataFrame(rows, columns=["conv", "piece", "cost"])
            rows = []
    yield pd.DataFrame(rows, columns=["conv", "piece", "cost"])


def _cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "piece", "first", "last", "closes", "total"]
    rows = []
    for (conv,), pieces in _grouped(frames, ["conv"]):
        known = [(p.piece, np.array(p.cost, dtype=float).reshape(4, 4)) for p in pieces]
        cost = np.array([0.0, NEVER, NEVER, NEVER])
        back = []
        for _, m in known:
            ways = cost[:, None] + m
            back.append(ways.argmin(axis=0))
            cost = ways.min(axis=0)
        q = int((cost + END).argmin())
        total = float((cost + END)[q])
        for i in range(len(known) - 1, -1, -1):
            before = int(back[i][q])
            rows.append((conv, known[i][0], before, q, i == len(known) - 1, total))
            q = before
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names)


RESULT = "new_role string, action string, n_inserted int, rendered string, cost double"


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "turn", "role", *(c.split()[0] for c in RESULT.split(", "))]
    rows = []
    for _, turns in _grouped(frames, ["conv", "piece"]):
        turns = list(turns)
        t = turns[0]
        done = repaired([role_of(x.role) for x in turns], [x.text for x in turns], int(t.first), int(t.last), bool(t.closes))
        rows += [(x.conv, x.turn, x.role, *d, t.total) for x, d in zip(turns, done, strict=True)]
        if len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names)


def repair_roles(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """One row a turn: conv_id, turn, role, new_role, action, n_inserted, rendered, cost (of the whole conversation).

    ``rendered`` in turn order, joined, is the repaired conversation.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.monotonically_increasing_id().alias("salt"))
    # pieces by the number of a turn in its conversation, so a conversation of any size and equal turn numbers are cut too
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    turns = unplaced(running_sums(placed(turns, order, Rounds(spark, "turns")), ["conv"], {"no": F.lit(1)})).drop("salt").withColumn("piece", F.floor((F.col("no") - 1) / piece))
    order = ["conv", "piece", "no"]
    costs = turns.select("conv", "piece", "no", "role").repartition(parts, "conv", "piece").sortWithinPartitions(*order).drop("no")
    costs = map_exact(costs, ["conv"], _pieces, "piece long, cost array<double>")
    cuts = map_exact(costs.repartition(parts, "conv").sortWithinPartitions("conv", "piece"), ["conv"], _cuts, "piece long, first int, last int, closes boolean, total double")
    cuts = scratch.keep(cuts.select(F.col("conv").alias("of"), F.col("piece").alias("nth"), "first", "last", "closes", "total"), "cuts")
    known = turns.join(cuts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("nth"))).drop("of", "nth")
    out = map_exact(known.repartition(parts, "conv", "piece").sortWithinPartitions(*order), ["conv", "turn"], _repair, f"role string, {RESULT}")
    return out.withColumnRenamed("conv", "conv_id")
