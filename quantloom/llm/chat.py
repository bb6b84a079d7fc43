"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal conversations: an optional system turn, then user and assistant in turn, user first, assistant last. For each turn the
dynamic program may keep its role, relabel it, or merge it into the turn before, each after inserting the empty turns that
the automaton needs; the cheapest sequence of choices wins, ties by the order of the choices below.

Turns are range-partitioned by conversation and turn, so a conversation that holds a third of all turns spans many tasks; the
number of ranges follows the bytes of text (range_bytes), so a task's memory does not grow with the table.
Costs over a run of turns are a small min-plus matrix over the automaton's states. Each task reports the matrices of its first
and last conversation only; the driver multiplies those (two per task) and tells each task the state and cost in which its
first conversation begins and the state in which its last one must end. Tasks then repair and render on their own.

Output, one row for each input turn: its position in its conversation (from 0), what it became and its piece of the rendering;
pieces of a conversation joined in order of position are the rendered conversation, so no row holds more than a turn and the
turns inserted around it.

Defined cases: null text is empty; a null or unknown role costs `unknown` to label and cannot be kept; turn order is turn
(nulls last), then role, then a hash of the text (ties by the text); repeated rows are turns each; rows with a null conv_id form one conversation; extra
columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

ROLES = ("system", "user", "assistant")
#: States: nothing said yet, then the role said last. NEXT: roles that may follow each state. Last turn: assistant.
STATES = ("start", *ROLES)
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
COSTS = {"merge": 1.0, "relabel": 2.0, "unknown": 1.0, "insert": 3.0}
INF = float("inf")


def _ways(costs: dict) -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest runs of inserted empty turns from each state to each state (roles inserted, system never)."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for a in range(4):
        frontier, seen = [(a, ())], {a}
        out[a, a] = ()
        while frontier:
            s, path = frontier.pop(0)
            for r in NEXT[s]:
                if r not in seen and r != 1:
                    seen.add(r)
                    out[a, r] = (*path, r)
                    frontier.append((r, (*path, r)))
    return out


def moves(role: int, costs: dict) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """(state before, state after, cost, action, roles inserted before) of one turn; role 0 is unknown."""
    out = []
    ways = _ways(costs)
    for (a, mid), inserted in ways.items():
        fee = costs["insert"] * len(inserted)
        for r in NEXT[mid]:
            if r == role:
                out.append((a, r, fee, "keep", inserted))
            else:
                out.append((a, r, fee + (costs["relabel"] if role else costs["unknown"]), "relabel", inserted))
    for r in (1, 2, 3):
        if r == role or not role:
            out.append((r, r, costs["merge"], "merge", ()))
    best: dict[tuple[int, int], tuple] = {}
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    for m in sorted(out, key=lambda m: (m[2], rank[m[3]], len(m[4]), m[4])):
        best.setdefault((m[0], m[1]), m)
    return [best[k] for k in sorted(best)]


def _tables(costs: dict):
    return _tables_of(tuple(sorted(costs.items())))


@functools.cache
def _tables_of(items: tuple):
    """For each role code: matrix of costs and the move behind each entry; and the closing run from each state."""
    costs, matrix, behind = dict(items), np.full((4, 4, 4), INF), {}
    for role in range(4):
        for a, b, c, action, inserted in moves(role, costs):
            matrix[role, a, b], behind[role, a, b] = c, (action, inserted)
    ways = _ways(costs)
    closing = {s: ways[s, 3] for s in range(4) if (s, 3) in ways}
    return matrix, behind, closing


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(1)


IDENTITY = np.where(np.eye(4) > 0, 0.0, INF)


def forward(roles: list[int], matrix: np.ndarray, begin: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Least cost of each state after each turn, and the state before it."""
    v, values, back = begin, [], []
    for r in roles:
        step = v[:, None] + matrix[r]
        back.append(step.argmin(0))
        v = step.min(0)
        values.append(v)
    return values, back


def repair(roles: list[int], costs: dict | None = None, begin: np.ndarray | None = None, end: int | None = None) -> list[tuple[str, int, tuple[int, ...]]]:
    """(action, new role, roles inserted before) of each turn. begin: costs of the states before; end: the state to end in
    (default: the one that is cheapest with its closing turns)."""
    matrix, behind, closing = _tables(costs or COSTS)
    values, back = forward(roles, matrix, begin if begin is not None else IDENTITY[0])
    if end is None:
        end = best_end(values[-1], costs)
    out = []
    for r, prev in zip(reversed(roles), reversed(back)):
        a = int(prev[end])
        action, inserted = behind[r, a, end]
        out.append((action, end, inserted))
        end = a
    return out[::-1]


def best_end(v: np.ndarray, costs: dict | None = None) -> int:
    costs = costs or COSTS
    closing = _tables(costs)[2]
    return min((float(v[s]) + costs["insert"] * len(closing.get(s, ())) if s in closing else INF, s) for s in range(1, 4))[1]


def _cut(table: pa.Table, *columns: str) -> tuple[list[int], list]:
    """Where each conversation of a table sorted like the task begins, the end last, and the columns as lists."""
    first, *rest = (table.column(c).to_pylist() for c in columns)
    return [i for i in range(len(first)) if i == 0 or first[i] != first[i - 1]] + [len(first)], [first, *rest]


def _sorted(table: pa.Table, *columns: str) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in columns])  # nulls last, bytes in order, as the range partitions have it


def format_chats(turns: DataFrame, costs: dict | None = None, range_bytes: int = 16 << 20) -> DataFrame:
    """conv_id, turn, role, position, new_role, action, inserted_before, closing, segment for each turn."""
    spark = turns.sparkSession
    ship(spark)
    costs = costs or COSTS
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim("role"))), F.lit(0)).cast("int")
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "hash")]
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // range_bytes))
    # written once, so that the borders of the ranges stay as they are from here on
    rows = rows.withColumns({"code": code, "hash": F.xxhash64("text")})
    dealt = materialise(rows.repartitionByRange(n, *order).withColumn("task", F.spark_partition_id()))
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}

    def matrices(key, table):
        """Min-plus matrices and numbers of turns of the first and the last conversation of a task; rows of equal role may
        stand in any order."""
        step, table = _tables(costs)[0], _sorted(table, "conv_id", "turn", "role")
        cuts, (convs, codes) = _cut(table, "conv_id", "code")
        out = []
        for j in sorted({0, len(cuts) - 2}):
            m = IDENTITY
            for c in codes[cuts[j] : cuts[j + 1]]:
                m = min_plus(m, step[c])
            out.append((key[0].as_py(), j == 0, j == len(cuts) - 2, convs[cuts[j]], m.ravel().tolist(), cuts[j + 1] - cuts[j]))
        kinds = [pa.int32(), pa.bool_(), pa.bool_(), table.schema.field("conv_id").type, pa.list_(pa.float64()), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["task", "first", "last", "conv_id", "m", "n"])

    ends = dealt.select("task", "conv_id", "turn", "role", "code").groupBy("task").applyInArrow(matrices, f"task int, first boolean, last boolean, conv_id {types['conv_id']}, m array<double>, n long").collect()
    borders = _borders([(r["task"], r["first"], r["last"], r["conv_id"], np.array(r["m"]).reshape(4, 4), r["n"]) for r in ends], costs)
    shared = spark.sparkContext.broadcast(borders)  # two entries for each task

    def apply(key, table):
        begins, stops, offsets = shared.value
        task, table, tail = key[0].as_py(), _sorted(table, "conv_id", "turn", "role", "hash", "text"), _tables(costs)[2]
        cuts, (_, codes, texts) = _cut(table, "conv_id", "code", "text")
        new, action, inserted, closing, segment, position = [], [], [], [], [], []
        for j in range(len(cuts) - 1):
            lo, hi = cuts[j], cuts[j + 1]
            begin = begins.get(task) if j == 0 else None
            stop = stops.get(task) if j == len(cuts) - 2 else None
            ahead = offsets.get(task, 0) if j == 0 else 0
            position += range(ahead, ahead + hi - lo)
            for i, (what, role, extra) in zip(range(lo, hi), repair(codes[lo:hi], costs, begin, stop)):
                after = tail[role] if i == hi - 1 and stop is None else ()
                new.append(ROLES[role - 1])
                action.append(what)
                inserted.append([ROLES[r - 1] for r in extra])
                closing.append([ROLES[r - 1] for r in after])
                begun = i > lo or begin is not None
                segment.append(render(what, role, extra, after, texts[i], begun, i == hi - 1 and stop is None))
        strings = pa.list_(pa.string())
        return pa.table([table.column("conv_id"), table.column("turn"), table.column("role"), pa.array(position, pa.int64()), pa.array(new, pa.string()), pa.array(action, pa.string()), pa.array(inserted, strings), pa.array(closing, strings), pa.array(segment, pa.string())], names=["conv_id", "turn", "role", "position", "new_role", "action", "inserted_before", "closing", "segment"])

    return dealt.groupBy("task").applyInArrow(apply, f"conv_id {types['conv_id']}, turn {types['turn']}, role string, position long, new_role string, action string, inserted_before array<string>, closing array<string>, segment string")


def render(action: str, role: int, inserted: tuple[int, ...], closing: tuple[int, ...], text: str, begun: bool, ends: bool) -> str:
    """A turn's piece of its conversation: headers of inserted and own roles, its text, and what closes the last turn."""
    if action == "merge":
        piece = f"\n\n{text}"
    else:
        heads = [f"<|{ROLES[r - 1]}|>\n" for r in (*inserted, role)]
        piece = ("\n" if begun else "") + "\n".join(heads) + text
    return piece + "".join(f"\n<|{ROLES[r - 1]}|>\n" for r in closing) + ("\n<|end|>\n" if ends else "")


def _borders(ends: list[tuple], costs: dict) -> tuple[dict[int, np.ndarray], dict[int, int], dict[int, int]]:
    """Costs of the states with which each task's first conversation goes on, the state in which its last one must end, and
    the number of turns of the first one that lie in tasks before."""
    ends = sorted(ends, key=lambda e: (e[0], not e[1]))
    begins: dict[int, np.ndarray] = {}
    stops: dict[int, int] = {}
    offsets: dict[int, int] = {}
    chain: list[tuple[int, np.ndarray, int]] = []  # runs of one conversation that goes over task borders

    def close() -> None:
        if len(chain) > 1:
            v, before = IDENTITY[0], []
            ahead = 0
            for task, m, n in chain:
                offsets[task], ahead = ahead, ahead + n
                before.append(v)
                v = (v[:, None] + m).min(0)
            state = best_end(v, costs)
            for i in reversed(range(len(chain))):
                task, m, _ = chain[i]
                if i < len(chain) - 1:
                    stops[task] = state
                state = int((before[i] + m[:, state]).argmin())
                begins[task] = IDENTITY[state]  # exactly the state in which the task before ends
            begins.pop(chain[0][0])
            offsets.pop(chain[0][0])
        chain.clear()

    at: tuple | None = None
    for task, first, last, conv, m, n in ends:
        if not (first and at == ("open", conv)):
            close()
        chain.append((task, m, n))
        at = ("open", conv) if last else None
    close()
    return begins, stops, offsets
