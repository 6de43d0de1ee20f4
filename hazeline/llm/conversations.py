"""Repair of conversations by the cheapest edits, as a shortest path over scalar integers.

A conversation should read ``(s?(ua)+)?`` in role initials. Each row is kept, given another
role or deleted, and a row with empty text may be put in before each row and at the end.
Paths run over the rows through the states nothing, s, u and a. An edit's weight is one
integer: its cost in the high digits and the letters that it adds to the audit in the low
digits, at the place of its row. A row owns two digits, the insertion and its own edit, filled
up with zeros at their end; as no code of a row begins another's, integers with equal costs
compare as the audits do, and the smallest integer is the answer: cost, audit and, as roles
follow from the audit, the repaired rows. Two insertions in one gap never pay: after nothing, u
or a they lead back to where they began, and after s deleting that row is cheaper.

A conversation may hold a third of all rows. Rows are collapsed to distinct ones with
a count, sorted and cut by range into pieces that no task finds too long, and a piece of an open
conversation is solved from every state to every state. Its result, the cost and the rank
of the audit among the ways out of one state, is one edge of the same graph one
level up, so pieces are joined by the same rule. Only the hash of the repaired text, which is
defined over the conversation in order, streams through one task, row by row.

Nulls are one space, but for conv_id in the result and turn in the order, where they come
first. Rows with equal turns are ordered by role, then by the first 32 bytes of the text, then
by its SHA-256. Repeated rows are duplicates. A conversation without rows after damage has
zeros, an empty audit and the hash of the empty string; an empty table gives no rows. Gaps beyond 64
bits count as 0. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import small_batches, store

#: States: nothing put out yet, and the last role put out.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Digits of the letters in an audit, in ASCII order; zero fills up.
LETTERS = "\0DIKR"
D, I, K, R = range(1, 5)
DIGIT = 3
#: Rows of a piece that are solved as one integer path; pieces of more rows are joined from blocks.
BLOCK = 128
MODULUS = 20

_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: One edge of a row: from state, to state, cost, first digit, second digit.
Edge = tuple[int, int, int, int, int]


@lru_cache(maxsize=None)
def row_edges(kind: str) -> tuple[Edge, ...]:
    """Edges of a row; kind is its role initial (x: any other), and x, t or . for deletable only, truncated, fine."""
    own, fault = kind
    extra = TRUNCATED if fault == "t" else 0
    out = []
    for state in range(4):
        for inserted in (False, True):
            at, paid, head = (_NEXT[state], INSERT, (I,)) if inserted else (state, 0, ())
            ways = [(at, DELETE, D)]
            if fault != "x":
                if own in _STATE and (_STATE[own] == _NEXT[at] or own == "s" and at == NOTHING):
                    ways.append((_STATE[own], extra, K))
                ways.append((_NEXT[at], REROLE + extra, R))
            for to, cost, letter in ways:
                digits = (*head, letter, 0)[:2]
                out.append((state, to, paid + cost, *digits))
    return tuple(out)


#: Edges behind the last row: nothing to add, or one insertion; the conversation ends with nothing or a.
END: tuple[Edge, ...] = ((NOTHING, NOTHING, 0, 0, 0), (ASSISTANT, ASSISTANT, 0, 0, 0), (USER, ASSISTANT, INSERT, I, 0))


def cheapest(steps: list[tuple[Edge, ...]], start: int) -> dict[int, int]:
    """The smallest sum of weights from ``start`` to each state that can be reached.

    A weight is cost << width | digits at the step's own place, so plain addition and plain
    minima order paths by cost and then by audit.
    """
    width = 2 * DIGIT * len(steps)
    best = {start: 0}
    for i, edges in enumerate(steps):
        place = width - 2 * DIGIT * (i + 1)
        now: dict[int, int] = {}
        for state, to, cost, one, two in edges:
            if state in best:
                value = best[state] + (cost << width) + ((one << DIGIT | two) << place)
                if to not in now or value < now[to]:
                    now[to] = value
        best = now
    return best


def unpack(value: int, n: int) -> tuple[int, list[tuple[int, int]]]:
    """Cost and the two digits of each of ``n`` steps."""
    width, mask = 2 * DIGIT * n, (1 << DIGIT) - 1
    digits = value & ((1 << width) - 1)
    pairs = [(digits >> (width - 2 * DIGIT * i - DIGIT) & mask, digits >> (width - 2 * DIGIT * (i + 1)) & mask) for i in range(n)]
    return value >> width, pairs


def as_edges(steps: list[tuple[Edge, ...]]) -> tuple[Edge, ...]:
    """A run of steps as one step: an edge for each pair of states, its digit the audit's rank.

    From one state two ways out never have the same audit, as the state follows from it, and
    none begins another; so the rank stands for the audit, whatever follows.
    """
    width = 2 * DIGIT * len(steps)
    out = []
    for start in range(4):
        ways = cheapest(steps, start)
        for rank, to in enumerate(sorted(ways, key=lambda s: ways[s] & ((1 << width) - 1)), 1):
            out.append((start, to, ways[to] >> width, rank, 0))
    return tuple(out)


def _targets(steps: list[tuple[Edge, ...]], start: int, value: int) -> list[int]:
    """The states behind each step of the path that ``value`` stands for."""
    states = []
    for edges, (one, two) in zip(steps, unpack(value, len(steps))[1], strict=True):
        start = next(to for state, to, _, a, b in edges if state == start and (a, b) == (one, two))
        states.append(start)
    return states


def solve(kinds: list[str], start: int, goal: int | None) -> tuple[int, list[tuple[int, int]], int]:
    """Cost, digits of each row (and of the end, if there is no goal) and the last state.

    ``goal`` is the state to reach; None means that the conversation ends behind these rows.
    """
    steps = [row_edges(k) for k in kinds]
    if goal is None:
        steps.append(END)
    if len(steps) <= BLOCK:
        ways = cheapest(steps, start)
        to = min(ways, key=ways.__getitem__) if goal is None else goal
        return *unpack(ways[to], len(steps)), to
    blocks = [steps[i : i + BLOCK] for i in range(0, len(steps), BLOCK)]
    path, cost = through([as_edges(b) for b in blocks], start, goal)
    digits: list[tuple[int, int]] = []
    for block, to in zip(blocks, path, strict=True):
        digits += unpack(cheapest(block, start)[to], len(block))[1]
        start = to
    return cost, digits, path[-1]


def through(levels: list[tuple[Edge, ...]], start: int, goal: int | None) -> tuple[list[int], int]:
    """The states behind each of many steps on the cheapest path, and its cost."""
    if len(levels) <= BLOCK:
        ways = cheapest(levels, start)
        to = min(ways, key=ways.__getitem__) if goal is None else goal
        return _targets(levels, start, ways[to]), ways[to] >> (2 * DIGIT * len(levels))
    groups = [levels[i : i + BLOCK] for i in range(0, len(levels), BLOCK)]
    ends, cost = through([as_edges(g) for g in groups], start, goal)
    path: list[int] = []
    for group, to in zip(groups, ends, strict=True):
        path += _targets(group, start, cheapest(group, start)[to])
        start = to
    return path, cost


def letters(digits: list[tuple[int, int]]) -> str:
    return "".join(LETTERS[x] for pair in digits for x in pair if x)


def outcome(kinds: list[str], digits: list[tuple[int, int]], state: int) -> tuple[str, ...]:
    """What becomes of each step: K kept, u or a the row gets that role, - deleted; + (u) or * (a) before it for an insertion."""
    out = []
    for i, pair in enumerate(digits):
        text = ""
        for x in pair:
            if x == D:
                text += "-"
            elif x == I:
                state = _NEXT[state]
                text += "+" if state == USER else "*"
            elif x == K:
                state = _STATE[kinds[i][0]]
                text += "K"
            elif x == R:
                state = _NEXT[state]
                text += "u" if state == USER else "a"
        out.append(text)
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> tuple[int, str, tuple[str, ...]]:
    rows = [kinds[i : i + 2] for i in range(0, len(kinds), 2)]
    cost, digits, _ = solve(rows, NOTHING, None)
    return cost, letters(digits), outcome(rows, digits, NOTHING)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times (0 to 2) of every row: damaged by crc32 of ``conv_id:turn`` modulo 20."""
    said = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(said.cast("binary")) % MODULUS
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("times"),
    )


def _mark(text) -> object:
    """Stands for a text: its first 32 bytes (zeros fill up), for the order, and its SHA-256."""
    raw = F.encode(text, "UTF-8")
    return F.concat(F.rpad(raw, 32, F.lit(b"\0")), F.unhex(F.sha2(raw, 256)))


def _skeleton(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``damage`` without their texts: mark of the text, times, fault and whether it is its first place."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "fine").otherwise("truncated")
    marked = rows.where("times > 0").select("conv_id", "turn", "role", _mark(F.col("text")).alias("mark"), fault.alias("fault"), "times")
    whole = marked.groupBy("conv_id", "turn", "role", "mark", "fault").agg(F.sum("times").alias("times"))
    # a struct orders nulls first; with the turn in the key of the join no text and no conversation is a hot key
    first = marked.groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn")).alias("first"))
    keys = {"conv_id": F.col("conv_id"), "turn": F.col("first.turn"), "role": F.col("role"), "mark": F.col("mark")}
    first = first.select(*(column.alias(f"first_{name}") for name, column in keys.items()), F.lit(True).alias("new"))
    same = [F.col(name).eqNullSafe(F.col(f"first_{name}")) for name in keys]
    joined = whole.join(first, same[0] & same[1] & same[2] & same[3], "left")
    return joined.select("conv_id", "turn", "role", "mark", "fault", "times", F.coalesce("new", F.lit(False)).alias("new"))


def _pieces(skeleton: DataFrame) -> DataFrame:
    """conv_id, piece (number of the range), rows: runs of each conversation in order, each within one range of all rows."""
    order = ["conv_id", "turn", "role", "mark"]
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    way = F.when(F.col("fault") == "blank", "x").when(~F.col("new"), "x").when(F.col("fault") == "truncated", "t").otherwise(".")
    ranged = skeleton.repartitionByRange(*order).select("*", F.concat(own, way).alias("kind"), F.spark_partition_id().alias("piece"))
    row = F.struct("turn", "role", "mark", "kind", "fault", "times")
    return ranged.select("conv_id", "piece", row.alias("row")).groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _choices(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, start, goal of the pieces of conversations that lie in several ranges.

    Each piece is one step with at most 16 edges; a conversation has at most one piece a range.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = []
            for kinds in batch.column("kinds").to_pylist():
                steps = [row_edges(kinds[i : i + 2]) for i in range(0, len(kinds), 2)]
                while len(steps) > 1:
                    steps = [as_edges(steps[i : i + BLOCK]) for i in range(0, len(steps), BLOCK)]
                tables.append([x for edge in as_edges(steps) for x in edge])
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "piece": batch.column("piece"), "edges": pa.array(tables, pa.list_(pa.int64()))})

    def chain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        levels = [tuple(tuple(flat[i : i + 5]) for i in range(0, len(flat), 5)) for flat in table.column("edges").to_pylist()]
        path, _ = through([*levels, END], NOTHING, None)
        goals = path[:-1]
        starts = [NOTHING, *goals[:-1]]
        last = [i == len(goals) - 1 for i in range(len(goals))]
        return pa.table({"conv_id": table.column("conv_id"), "piece": table.column("piece"), "start": pa.array(starts, pa.int32()), "goal": pa.array(goals, pa.int32()), "is_last": pa.array(last, pa.bool_())})

    id_type = pieces.schema["conv_id"].dataType.simpleString()
    some = pieces.mapInArrow(edges, f"conv_id {id_type}, piece int, edges array<bigint>")
    return some.groupBy("conv_id").applyInArrow(chain, f"conv_id {id_type}, piece int, start int, goal int, is_last boolean")


def _edited(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, cost, audit, out (what becomes of each row), tail (insertion at the end) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, outs, tails = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("kinds", "extra", "start", "goal", "is_last"))
            for kinds, extra, start, goal, is_last in zip(*columns, strict=True):
                n = len(kinds) // 2
                if start is None:
                    cost, audit, out = _short(kinds) if n <= BLOCK // 2 else _long(kinds, NOTHING, None)
                else:
                    cost, audit, out = _long(kinds, start, goal)
                    if is_last and goal == USER:
                        cost, audit, out = cost + INSERT, audit + "I", (*out, "*")
                tails.append(out[n] if len(out) > n else "")
                if any(extra):
                    audit = _with_copies(audit, extra)
                    cost += DELETE * sum(extra)
                costs.append(cost)
                audits.append(audit)
                outs.append(list(out[:n]))
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column("conv_id"), "piece": batch.column("piece"), "cost": pa.array(costs, pa.int64()),
                    "audit": pa.array(audits, pa.string()), "out": pa.array(outs, pa.list_(pa.string())), "tail": pa.array(tails, pa.string()),
                }
            )

    id_type = pieces.schema["conv_id"].dataType.simpleString()
    extra = F.transform("rows", lambda r: r["times"] - 1).alias("extra")
    asked = pieces.select("conv_id", "piece", "kinds", extra, "start", "goal", "is_last")
    return asked.mapInArrow(run, f"conv_id {id_type}, piece int, cost bigint, audit string, out array<string>, tail string")


def _long(kinds: str, start: int, goal: int | None) -> tuple[int, str, tuple[str, ...]]:
    rows = [kinds[i : i + 2] for i in range(0, len(kinds), 2)]
    cost, digits, _ = solve(rows, start, goal)
    return cost, letters(digits), outcome(rows, digits, start)


def _with_copies(audit: str, extra: list[int]) -> str:
    """The audit with a D for each further copy of a row, behind that row's own letter.

    Copies must go, and an insertion beside them reads least behind them: D comes before I.
    """
    out, at = [], 0
    for n in extra:
        if audit[at] == "I":
            out.append("I")
            at += 1
        out.append(audit[at] + "D" * n)
        at += 1
    return "".join(out) + audit[at:]


def _hashes(damaged: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: lines ``role:text`` of the kept rows in order, joined by newlines.

    Rows and what becomes of them meet in the order of the conversation, streamed by task.
    """
    none = F.lit(None)
    texts = damaged.where("times > 0").select("conv_id", F.lit(0).alias("behind"), "turn", "role", _mark(F.col("text")).alias("mark"), F.lit(1).alias("side"), none.cast("string").alias("out"), "text")
    marks = kept.select("conv_id", "behind", "turn", "role", "mark", F.lit(0).alias("side"), "out", none.cast("string").alias("text"))
    both = marks.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "behind", "turn", "role", "mark", "side")
    names = {"+": "user", "*": "assistant", "u": "user", "a": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state, first, out = None, False, hashlib.sha256(), True, None

        def line(text: str) -> None:
            nonlocal first
            state.update(text.encode("utf-8", "surrogatepass") if first else b"\n" + text.encode("utf-8", "surrogatepass"))
            first = False

        for batch in batches:
            ids, hashes = [], []
            id_kind = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "side", "out"))
            for own, role, side, word, text in zip(*columns, batch.column("text"), strict=True):
                if not begun or own != conv:
                    if begun:
                        ids.append(conv)
                        hashes.append(state.hexdigest())
                    conv, begun, state, first, out = own, True, hashlib.sha256(), True, None
                if side == 0:
                    out = word
                    if out[0] in "+*":
                        line(f"{names[out[0]]}:")
                        out = out[1:]
                    if out in ("", "-"):
                        out = None
                elif out is not None:
                    # a row's mark comes right before it; further copies find none
                    line(f"{role if out == 'K' else names[out]}:{text.as_py()}")
                    out = None
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, id_kind), "repaired_sha256": pa.array(hashes, pa.string())})
        if begun:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], id_kind), "repaired_sha256": pa.array([state.hexdigest()], pa.string())})

    id_type = damaged.schema["conv_id"].dataType.simpleString()
    return both.select("conv_id", "role", "side", "out", "text").mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit and the hash of the repaired text (see the module)."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select("conv_id", "turn", "role", "text")
    damaged = damage(rows)
    skeleton = _skeleton(damaged)
    pieces = _pieces(skeleton)
    firsts = F.element_at("rows", 1)["kind"], F.element_at("rows", -1)["kind"]
    pieces = pieces.select(
        "conv_id", "piece", "rows", F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"),
        F.substring(firsts[0], 1, 1).alias("first"), F.substring(firsts[1], 1, 1).alias("last"),
    )
    pieces = store(pieces, "conversation-pieces")
    many = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("open_id"))
    open_pieces = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("open_id")), "left_semi").select("conv_id", "piece", "kinds")
    chosen = store(_choices(open_pieces), "conversation-states")
    same = pieces["conv_id"].eqNullSafe(chosen["conv_id"]) & (pieces["piece"] == chosen["piece"])
    asked = pieces.join(chosen, same, "left").select(pieces["*"], chosen["start"], chosen["goal"], chosen["is_last"])
    edited = store(_edited(asked), "conversation-edits")

    same = pieces["conv_id"].eqNullSafe(edited["conv_id"]) & (pieces["piece"] == edited["piece"])
    joined = pieces.join(edited, same).select(pieces["*"], edited["out"], edited["tail"])
    line = F.explode(F.zip_with("rows", "out", lambda r, o: F.struct(r.alias("row"), o.alias("out"))))
    own = joined.select("conv_id", line.alias("x")).where("x.out != '-'")
    kept = own.select("conv_id", F.lit(0).alias("behind"), "x.row.turn", "x.row.role", "x.row.mark", "x.out")
    turn_type = rows.schema["turn"].dataType
    tails = joined.where("tail != ''").select(
        "conv_id", F.lit(1).alias("behind"), F.lit(None).cast(turn_type).alias("turn"), F.lit("").alias("role"),
        F.lit(b"").cast("binary").alias("mark"), F.col("tail").alias("out"),
    )
    hashes = _hashes(damaged, kept.unionByName(tails))
    return _report(rows, joined, edited, hashes)


def _report(rows: DataFrame, pieces: DataFrame, edited: DataFrame, hashes: DataFrame) -> DataFrame:
    """Counts of pieces added up by conversation; what lies between two pieces is added by their order."""

    def total(test) -> object:
        return F.aggregate(F.filter("rows", test), F.lit(0).cast("long"), lambda s, r: s + r["times"])

    initials = F.transform("rows", lambda r: F.substring(r["kind"], 1, 1))
    pairs = F.zip_with(F.slice(initials, 1, F.size("rows") - 1), F.slice(initials, 2, F.size("rows")), lambda a, b: F.concat(a, b))
    wrong = F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))
    copies = F.aggregate("rows", F.lit(0).cast("long"), lambda s, r: s + r["times"] - 1)
    turns = F.array_compact(F.transform("rows", lambda r: r["turn"]))
    counted = pieces.select(
        "conv_id", F.struct("piece", "first", "last", F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(turns)).cast("long").alias("distinct")).alias("edge"),
        total(lambda r: r["fault"] == "blank").alias("blank"),
        # copies of a row behind its first place, and all of a row that is not new
        (F.aggregate(F.filter("rows", lambda r: r["fault"] != "blank"), F.lit(0).cast("long"), lambda s, r: s + F.when((F.substring(r["kind"], 2, 1) == "x"), r["times"]).otherwise(r["times"] - 1))).alias("duplicate"),
        F.aggregate(F.filter("rows", lambda r: F.substring(r["kind"], 2, 1) == "t"), F.lit(0).cast("long"), lambda s, r: s + 1).alias("truncated"),
        # neighbours with one initial are never right, and copies are neighbours
        (F.size(wrong).cast("long") + copies).alias("illegal"),
    )
    sums = counted.groupBy("conv_id").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    between = F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges")), lambda a, b: F.struct(F.concat(a["last"], b["first"]).alias("pair"), (a["high"] == b["low"]).alias("same")))
    between = F.filter(between, lambda x: x["pair"].isNotNull())
    low, high = F.array_min(F.transform("edges", lambda e: e["low"])), F.array_max(F.transform("edges", lambda e: e["high"]))
    # a turn that lies in two pieces counts once
    distinct = F.aggregate("edges", F.lit(0).cast("long"), lambda s, e: s + e["distinct"]) - F.size(F.filter(between, lambda x: x["same"]))
    sums = sums.select(
        "conv_id", F.coalesce(F.try_add(F.try_subtract(high, low), 1 - distinct), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.size(F.filter(between, lambda x: ~x["pair"].isin("su", "ua", "au")))).alias("illegal"),
    )
    audits = edited.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("audits"))
    audits = audits.select("conv_id", "cost", F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit"))

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    texts = ("audit", "repaired_sha256")

    def part(df: DataFrame) -> DataFrame:
        missing = [F.lit(None).cast("long" if c in counts else "string").alias(c) for c in counts + texts if c not in df.columns]
        return df.select("*", *missing).select("conv_id", *counts, *texts)

    every = rows.select("conv_id").distinct()
    united = part(every).unionByName(part(sums)).unionByName(part(audits)).unionByName(part(hashes))
    found = united.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), *(F.max(c).alias(c) for c in texts))
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
