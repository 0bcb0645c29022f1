"""Chat formatting by minimum-cost role repair.

A legal chat has at most one system message, at its start, then user and assistant messages in turn,
from a user on; it may end after either. Dynamic programming over the states of that automaton chooses, for each
turn, the cheapest of: keep its role, merge it into the message before, give it another role, or insert an
empty message first. Costs add up, so stretches of a long conversation become small cost matrices (from the
state before to the state after) that are joined in order, and each stretch is then repaired by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebeam.llm.common import stage

ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: States: nothing yet, after a system, a user, an assistant message.
STATES = 4
#: Names of roles that mean one of the three.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Turns of a stretch, and bytes of text after which it ends.
STRETCH, STRETCH_BYTES = 4096, 1 << 23
NEVER = 1 << 40


@dataclass(frozen=True)
class Costs:
    """Of a merge into a message of the same role, or of another; of another role; of a role where none is known; of an empty message."""

    merge_same: int = 1
    merge_other: int = 3
    relabel: int = 2
    unknown: int = 1
    insert: int = 4


@lru_cache(maxsize=16)
def moves(costs: Costs) -> tuple:
    """For each role of a turn, for each state: its moves as (cost, rank, messages before, own message or None, state after).

    Messages are role numbers; None merges. Of equal costs the lower rank is taken: keep, merge, relabel, insert.
    """
    after = {SYSTEM: 1, USER: 2, ASSISTANT: 3}
    legal = {0: (SYSTEM, USER), 1: (USER,), 2: (ASSISTANT,), 3: (USER,)}
    out = []
    for role in range(4):
        by_state = []
        for q in range(STATES):
            found = []
            for m in legal[q]:
                cost = 0 if m == role else costs.unknown if role == OTHER else costs.relabel
                found.append((cost, 0 if m == role else 2, (), m, after[m]))
            if q:
                same = role in (q - 1, OTHER)
                found.append((costs.merge_same if same else costs.merge_other, 1, (), None, q))
            for e in legal[q]:  # an empty message, then the turn as what may follow
                for m in legal[after[e]]:
                    cost = costs.insert + (0 if m == role else costs.unknown if role == OTHER else costs.relabel)
                    found.append((cost, 3, (e,), m, after[m]))
            by_state.append(tuple(sorted(found, key=lambda f: (f[0], f[1], f[2], -1 if f[3] is None else f[3]))))
        out.append(tuple(by_state))
    return tuple(out)


def ends(costs: Costs) -> tuple:
    """Cost and messages that end a chat from each state: none, or an empty user message where there is none yet."""
    return ((costs.insert, (USER,)), (costs.insert, (USER,)), (0, ()), (0, ()))


def matrix(roles: list[int], costs: Costs) -> list[list[int]]:
    """Least cost from each state to each through these turns."""
    table = moves(costs)
    rows = [[0 if p == q else NEVER for q in range(STATES)] for p in range(STATES)]
    for role in roles:
        for p in range(STATES):
            new = [NEVER] * STATES
            for q, c in enumerate(rows[p]):
                if c < NEVER:
                    for cost, *_, to in table[role][q]:
                        if c + cost < new[to]:
                            new[to] = c + cost
            rows[p] = new
    return rows


def path(roles: list[int], start: int, end: int, costs: Costs) -> list[tuple]:
    """The moves of least cost from start to end; of equals, at each turn from the last on the first by rank and state."""
    table = moves(costs)
    best = [[NEVER] * STATES for _ in range(len(roles) + 1)]
    best[0][start] = 0
    come: list[list] = []
    for k, role in enumerate(roles):
        how: list = [None] * STATES
        for q in range(STATES):
            if best[k][q] < NEVER:
                for move in table[role][q]:
                    c, to = best[k][q] + move[0], move[4]
                    if c < best[k + 1][to] or (c == best[k + 1][to] and (move[1], q) < (how[to][0][1], how[to][1])):
                        best[k + 1][to], how[to] = c, (move, q)
        come.append(how)
    out, q = [], end
    for how in reversed(come):
        move, q = how[q]
        out.append(move)
    return out[::-1]


def render(role: str, text: str) -> str:
    """One message of the template; a chat is its messages one after the other."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def stretches(turns: DataFrame) -> DataFrame:
    """conv_id, part and turns (turn, code, text, in order) of each stretch; parts of a conversation ascend.

    Rows are sorted over all tasks by range, so that a conversation of any size, or many rows of one turn, lies in as
    many tasks as it fills; each task cuts what it has into stretches.
    """
    name = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    for alias, role in ALIASES.items():
        name = F.when(name == alias, role).otherwise(name)
    code = F.lit(OTHER)
    for k, role in enumerate(ROLES):
        code = F.when(name == role, k).otherwise(code)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # repeated rows may be dealt to several tasks: the tie keeps them apart, and any order of them gives the same chat
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("code"), text.alias("text"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "code", "mark", "tie"]
    longest, most_bytes = STRETCH, STRETCH_BYTES

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv = b.column(0)
            ids, none = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            filled = np.cumsum(pc.binary_length(b.column(3)).to_numpy().astype(np.int64)) // most_bytes
            new = np.ones(n, bool)
            new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]) | (filled[1:] != filled[:-1])
            since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            start = np.flatnonzero(since % longest == 0)
            rows = pa.StructArray.from_arrays([b.column(k) for k in (1, 2, 3)], names=["turn", "code", "text"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, n], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(start)), pa.array(part + np.arange(len(start))), lists], names=["conv_id", "part", "turns"])
            part += len(start)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(cut, "conv_id long, part long, turns array<struct<turn: long, code: int, text: string>>")


def repair(turns: DataFrame, costs: Costs | None = None) -> DataFrame:
    """conv_id, message, role, first_turn, n_turns, text and rendered of each message of the repaired chats.

    turns: conv_id, turn, role, text. Roles are read in any case, known aliases included; null and strange
    roles may become any at a small cost. Null text is empty. Merged turns are joined by a line end; an
    inserted message has no text, no first turn and n_turns 0. Turns of one number are ordered by role and a hash of the
    text, repeated rows stay; a null turn comes first; null conversation ids form one conversation. An empty table gives no
    rows; other columns play no part.

    A stretch has STRETCH turns at most and, but for its first text, STRETCH_BYTES; of a longer conversation, only
    matrices meet.
    """
    costs = costs or Costs()
    parts = stage(stretches(turns), "chat-parts")

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [[x for row in matrix(codes, costs) for x in row] for codes in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "costs"])

    measured = parts.select("conv_id", "part", F.col("turns.code").alias("codes")).mapInArrow(measure, "conv_id long, part long, costs array<long>")

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for conv, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                best, come = [0, NEVER, NEVER, NEVER], []
                for part in found:
                    c = part["costs"]
                    how = [min((best[p] + c[STATES * p + q], p) for p in range(STATES)) for q in range(STATES)]
                    best = [h[0] for h in how]
                    come.append([h[1] for h in how])
                q = min(range(STATES), key=lambda q: (best[q] + ends(costs)[q][0], q))
                route = []
                for part, how in zip(reversed(found), reversed(come), strict=True):
                    route.append((conv, part["part"], how[q], q, int(part is found[-1])))
                    q = how[q]
                for r in route:
                    for col, v in zip(cols, r, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["conv_id", "part", "start", "end", "is_last"])

    whole = measured.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("found"))
    routes = whole.mapInArrow(route, "conv_id long, part long, start long, end long, is_last long")
    placed = parts.alias("p").join(routes.alias("r"), F.col("p.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("p.part") == F.col("r.part")))
    placed = placed.select("p.conv_id", "p.part", "r.start", "r.end", "r.is_last", "p.turns")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for conv, part, start, end, is_last, turns_ in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found: list[list] = []  # role or None for the message before this part, first turn, turns, texts
                for t, (_, _, before, own, _) in zip(turns_, path([t["code"] for t in turns_], start, end, costs), strict=True):
                    found += [[e, None, 0, []] for e in before]
                    if own is not None:
                        found.append([own, t["turn"], 1, [t["text"]]])
                    elif not found:
                        found.append([None, t["turn"], 1, [t["text"]]])
                    else:
                        found[-1][1] = t["turn"] if not found[-1][2] else found[-1][1]
                        found[-1][2] += 1
                        found[-1][3].append(t["text"])
                if is_last:
                    found += [[e, None, 0, []] for e in ends(costs)[end][1]]
                for k, (role, first, n, texts) in enumerate(found):
                    for col, v in zip(cols, (conv, part, k, None if role is None else ROLES[role], first, n, "\n".join(texts)), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "part", "k", "role", "first_turn", "n_turns", "text"])

    pieces = stage(placed.mapInArrow(apply, "conv_id long, part long, k long, role string, first_turn long, n_turns long, text string"), "chat-pieces")
    # messages before each part; a part's first piece may belong to the message before it
    counts = pieces.groupBy("conv_id", "part").agg(F.count("role").alias("n"), F.max((F.col("role").isNull()).cast("int")).alias("joins"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = pieces.alias("p").join(counts.alias("c"), F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("p.part") == F.col("c.part")))
    message = F.col("c.base") + F.col("p.k") - F.col("c.joins")
    numbered = numbered.select("p.conv_id", message.cast("long").alias("message"), "p.part", "p.role", "p.first_turn", "p.n_turns", "p.text")
    # only messages that reach over a part's bound have more than one piece
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n_turns") > 0, F.struct("part", "text")))), lambda x: x["text"]), "\n")
    joined = numbered.groupBy("conv_id", "message").agg(F.max("role").alias("role"), F.min_by("first_turn", "part").alias("first_turn"), F.sum("n_turns").alias("n_turns"), text.alias("text"))
    return joined.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))
