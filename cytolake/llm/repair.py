"""Cheapest repair of damaged conversations, by a rank-convergence parallel Viterbi search.

A conversation is right if its roles are nothing, or an optional system turn and then user and assistant turns in pairs. The search
walks rows and four states: nothing yet, after a system, a user, an assistant turn. A row is kept, gets
the role that has to come next, or is deleted; a turn without text may be inserted anywhere.

Rows are sorted by conversation and turn over all tasks and cut into blocks, so a conversation of any length is many
segments of bounded size. Backward: every segment starts from a guess of the costs behind it, the costs of an end. Then
segments whose right neighbour found other costs start again from those, and stop as soon as old and new costs differ only by a constant,
which takes a few rows. This is repeated until no guess was wrong. The constants add up to the cost of the conversation. Forward: the stitched
costs tell for every state the edits of least audit; entry states are guessed and mended in the same way.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm.joins import broadcast_if_few
from cytolake.runtime import cut

# Costs of edits, what an unmended truncated row costs, and the initials of edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: state after the turn that has to come next, if no system turn is kept
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: state after a turn of a role is kept; roles are 0 system, 1 user, 2 assistant, 3 any other
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: faults, as the number of a row's code divided by 4 (the rest is its role)
FAULTS = ("", "blank", "duplicate", "truncated")
#: costs of an end of the conversation by state
END = (0, 2 * INSERT, INSERT, 0)

BLOCK_ROWS = 4096
Costs = tuple[int, int, int, int]

SEGMENT = "conv {kind}, block bigint, first bigint, codes array<tinyint>, opens boolean, more boolean, tail array<int>, head array<int>, base bigint"
STEP = "struct<row:bigint,number:int,edit:string,role:string,code:int>"
PATH = "conv {kind}, block bigint, entry int, leaves int, steps array<" + STEP + ">"
_STEP = pa.struct([("row", pa.int64()), ("number", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("code", pa.int32())])


def _relaxed(costs: Costs) -> Costs:
    """The costs once turns may be inserted first."""
    start, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + user), min(system, INSERT + user), user, assistant


def edits_of(state: int, code: int) -> list[tuple[str, int, int]]:
    """``(initial, cost, state after)`` of the edits of a row that use it up, in the order of their initials."""
    fault, role = divmod(code, 4)
    out = [("D", DELETE, state)]
    if FAULTS[fault] in ("", "truncated"):
        more = TRUNCATED if FAULTS[fault] else 0
        if (state, role) in KEPT:
            out.append(("K", more, KEPT[state, role]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


class Backward:
    """Costs before a row from those behind it, kept by costs and code: there are few of either."""

    def __init__(self) -> None:
        self.known: dict[tuple[Costs, int], tuple[Costs, int]] = {}

    def step(self, tail: Costs, code: int) -> tuple[Costs, int]:
        """Costs before the row less their minimum, and the minimum."""
        found = self.known.get((tail, code))
        if found is None:
            raw = _relaxed(tuple(min(c + tail[after] for _, c, after in edits_of(s, code)) for s in range(4)))
            low = min(raw)
            found = self.known[tail, code] = tuple(c - low for c in raw), low
        return found

    def head(self, codes: list[int], tail: Costs) -> tuple[Costs, int]:
        """Costs before all rows and the sum of the minima."""
        base = 0
        for code in reversed(codes):
            tail, low = self.step(tail, code)
            base += low
        return tail, base

    def again(self, codes: list[int], old: Costs, new: Costs, head: Costs, base: int) -> tuple[Costs, int]:
        """As :meth:`head` for ``new`` costs, given the result for ``old`` ones; only as far as they differ."""
        for code in reversed(codes):
            if old == new:
                return head, base
            (old, low), (new, other) = self.step(old, code), self.step(new, code)
            base += other - low
        return new, base

    def trace(self, codes: list[int], tail: Costs, state: int, more: bool) -> tuple[list[tuple[int, str, str | None]], int]:
        """Cheapest edits of least audit from ``state`` on: ``(row, initial, new role)``; and the state they lead to."""
        behind = [(tail, 0)]
        for code in reversed(codes):
            costs, low = self.step(behind[-1][0], code)
            behind.append((costs, behind[-1][1] + low))
        behind.reverse()
        out, row = [], 0
        while row < len(codes) or not more and END[state]:
            costs, base = behind[row]
            cost = costs[state] + base
            used = edits_of(state, codes[row]) if row < len(codes) else []
            for edit, own, after in sorted([*used, ("I", INSERT, NEXT[state])]):
                at = row if edit == "I" else row + 1
                if own + behind[at][0][after] + behind[at][1] == cost:
                    out.append((row, edit, ROLE[after] if edit in "IR" else None))
                    row, state = at, after
                    break
        return out, state


def _slices(batches: Iterator[pa.RecordBatch], most: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few segments: a segment's edits are many times its codes."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def _placed(turns: DataFrame, block_rows: int) -> DataFrame:
    """The rows in order: ``(conv, turn, role, text, row, block)``, stored.

    ``row`` counts upwards within a task, ``block`` over all of them. Bounds of the tasks look at 64 characters, so no
    text reaches the driver.
    """
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.concat_ws("\0", "role", "text")
    ordered = turns.repartitionByRange(tasks, "conv", "turn", F.substring(tie, 1, 64)).sortWithinPartitions("conv", "turn", tie)
    rows = cut(ordered.withColumn("row", F.monotonically_increasing_id()))
    task, within = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(task.alias("task")).count().collect()  # a number per task
    starts, total = [], 0
    for task_number, count in sorted(map(tuple, sizes)):
        starts.append((task_number, total))
        total += -(-count // block_rows)
    first = F.broadcast(turns.sparkSession.createDataFrame(starts, "task bigint, first_block bigint"))
    return rows.join(first, task == F.col("task")).withColumn("block", F.col("first_block") + F.floor(within / block_rows)).drop("task", "first_block")


def _coded(rows: DataFrame) -> DataFrame:
    """``(conv, block, row, code)``: role and first fault of every row."""
    initial = F.substring("role", 1, 1)
    blank = F.translate("text", WHITE, "") == ""
    cut_short = ~F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1).isin(*ENDS)
    short = rows.select(
        "conv", "block", "row", "role", F.sha2("text", 256).alias("content"), blank.alias("blank"), cut_short.alias("truncated"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
    )
    said = short.where("not blank").groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("content").alias("_content"))
    twice = cut(said.agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("content") == F.col("_content"))
    fault = F.when(F.col("blank"), 1).when(F.col("row") > F.col("_first"), 2).when(F.col("truncated"), 3).otherwise(0)
    return short.join(broadcast_if_few(twice), same, "left").select("conv", "block", "row", (F.col("kind") + 4 * fault).cast("tinyint").alias("code"))


def _beside(segments: DataFrame, step: int, column: str, name: str) -> DataFrame:
    """``segments`` with ``name``: ``column`` of the segment of the same conversation ``step`` blocks further."""
    other = segments.select(F.col("conv").alias("_conv"), (F.col("block") - step).alias("_block"), F.col(column).alias(name))
    return segments.join(other, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left").drop("_conv", "_block")


def _segments(rows: DataFrame) -> DataFrame:
    """The rows of a conversation in a block: ``(conv, block, first, codes, opens, more)``."""
    cells = F.sort_array(F.collect_list(F.struct("row", "code")))  # at most a block
    own = cut(_coded(rows).groupBy("conv", "block").agg(cells.alias("cells")))
    named = own.select("conv", "block", F.col("cells")[0]["row"].alias("first"), F.transform("cells", lambda c: c["code"]).alias("codes"))
    return _beside(_beside(named, 1, "first", "_right"), -1, "first", "_left").select(
        "conv", "block", "first", "codes", F.col("_left").isNull().alias("opens"), F.col("_right").isNotNull().alias("more")
    )


def _few(parts: DataFrame, many: int) -> DataFrame:
    """Segments in as many tasks as work at once, or more of up to 64 segments each."""
    return parts.coalesce(max(parts.sparkSession.sparkContext.defaultParallelism, -(-many // 64)))


def _path_columns(segments: list[tuple]) -> dict[str, pa.Array]:
    """Columns ``leaves`` and ``steps`` of ``(first, codes, (path, state))`` segments, or of None."""
    steps = [
        own and [  # what is inserted at the end stands behind the last row
            dict(zip(_STEP.names, (own[0] + min(r, len(own[1]) - 1), k, e, role, own[1][r] if e != "I" else None))) for k, (r, e, role) in enumerate(own[2][0])
        ]
        for own in segments
    ]
    return {"leaves": pa.array([own and own[2][1] for own in segments], pa.int32()), "steps": pa.array(steps, pa.list_(_STEP))}


def stitched(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The edits of conversations that lie in one block, as :func:`traced` gives them; the segments of the others with the costs
    behind (``tail``) and before (``head``, ``base``) them, no guess left; and how many segments these are."""
    segments = _segments(rows)
    kind = rows.schema["conv"].dataType.simpleString()

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Backward()
        for batch in _slices(batches):
            told = list(zip(*[batch.column(n).to_pylist() for n in ("codes", "first", "opens", "more")]))
            heads = [(None, None) if opens and not more else search.head(codes, END) for codes, _, opens, more in told]
            paths = [(first, codes, search.trace(codes, END, START, more)) if opens and not more else None for codes, first, opens, more in told]
            for name, values in (("tail", [END] * len(heads)), ("head", [h for h, _ in heads])):
                batch = batch.append_column(name, pa.array([v and list(v) for v in values], pa.list_(pa.int32())))
            batch = batch.append_column("base", pa.array([b for _, b in heads], pa.int64()))
            for name, values in ({"entry": pa.array([START] * len(told), pa.int32())} | _path_columns(paths)).items():
                batch = batch.append_column(name, values)
            yield batch

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Backward()
        for batch in batches:
            names = ("codes", "tail", "want", "head", "base")
            told = [(c, tuple(t), tuple(t if w is None else w), tuple(h), b) for c, t, w, h, b in zip(*[batch.column(n).to_pylist() for n in names])]
            new = [search.again(*own) for own in told]  # stops at once where the costs were right
            kept = batch.select(batch.schema.names[:6])
            for name, values in (("tail", [own[2] for own in told]), ("head", [h for h, _ in new])):
                kept = kept.append_column(name, pa.array(map(list, values), pa.list_(pa.int32())))
            yield kept.append_column("base", pa.array([b for _, b in new], pa.int64()))

    schema = SEGMENT.format(kind=kind)
    found = cut(segments.mapInArrow(guess, f"{schema}, entry int, leaves int, steps array<{STEP}>"))
    whole = found.where("opens and not more").select("conv", "block", "entry", "leaves", "steps")
    parts = found.where("more or not opens").drop("entry", "leaves", "steps")
    many = parts.count()
    parts = cut(_few(parts, many))
    while True:
        told = cut(_few(_beside(parts, 1, "head", "want"), many))
        if told.where("want <> tail").isEmpty():
            return whole, parts, many
        parts = cut(told.mapInArrow(mend, schema))


def traced(segments: DataFrame, many: int) -> DataFrame:
    """``(conv, block, entry, leaves, steps)``: the edits of ``many`` segments and the states around them."""
    kind = segments.schema["conv"].dataType.simpleString()

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Backward()
        for batch in batches:
            names = ("codes", "tail", "more", "entry", "leaves", "want")
            told = list(zip(*[batch.column(n).to_pylist() for n in names]))
            leaves = [old if want in (None, entry) else search.trace(codes, tuple(tail), want, more)[1] for codes, tail, more, entry, old, want in told]
            kept = batch.select(batch.schema.names[:6])
            kept = kept.append_column("entry", pa.array([entry if want is None else want for *_, entry, _, want in told], pa.int32()))
            yield kept.append_column("leaves", pa.array(leaves, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Backward()
        for batch in _slices(batches):
            told = zip(*[batch.column(n).to_pylist() for n in ("codes", "tail", "first", "more", "entry")])
            paths = [(first, codes, search.trace(codes, tuple(tail), entry, more)) for codes, tail, first, more, entry in told]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("conv", "block", "entry")} | _path_columns(paths))

    schema = f"conv {kind}, block bigint, first bigint, codes array<tinyint>, more boolean, tail array<int>, entry int, leaves int"
    none = F.lit(None).cast("int")
    told = segments.select("conv", "block", "first", "codes", "more", "tail", none.alias("entry"), none.alias("leaves"), F.lit(START).alias("want"))
    while True:
        parts = cut(told.mapInArrow(mend, schema))
        told = cut(_few(_beside(parts, -1, "leaves", "want"), many))
        if told.where("want <> entry").isEmpty():
            return parts.mapInArrow(run, PATH.format(kind=kind))


def repair(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A row per edit: ``(conv, row, number, edit, fault, kind, turn, role, text)``.

    The repaired conversation is the rows whose ``edit`` is not D, by ``(row, number)``; ``role`` is the repaired one, inserted
    turns (I) have an empty text and no fault or turn. ``fault`` is a row's first of blank, duplicate and truncated, else
    empty, and ``kind`` its role before (0 system, 1 user, 2 assistant, 3 other, by initials). Rows are taken by turn, null turns
    first, and within a turn by role and text. Null roles and texts count as empty; rows without a conversation are one
    conversation; repeated rows are duplicates. An empty table gives no row; other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = turns.select(F.col(conv_column).alias("conv"), F.col(turn_column).alias("turn"), text(role_column).alias("role"), text(text_column).alias("text"))
    rows = _placed(named, block_rows)
    whole, parts, many = stitched(rows)
    steps = whole.unionByName(traced(parts, many)).select("conv", F.inline("steps")).withColumnRenamed("role", "new_role")
    said = rows.select(F.col("row").alias("_row"), "turn", F.col("role").alias("_role"), "text")
    told = steps.join(said, F.col("row") == F.col("_row"))  # every step has a row, inserted ones that beside them
    own = F.col("edit") != "I"
    return told.select(
        "conv", "row", "number", "edit", F.when(own, F.element_at(F.array(*map(F.lit, FAULTS)), F.shiftright("code", 2) + 1)).alias("fault"),
        F.when(own, F.col("code") % 4).alias("kind"), F.when(own, F.col("turn")).alias("turn"),
        F.coalesce("new_role", "_role").alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"),
    )


def digests(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per conversation of ``conversations`` (column ``conv``, distinct): counts of faults, cost, audit and a hash of what is left.

    Audit and hash run through a conversation in order, so its edits stream through one task, sorted on disk; nothing but the
    audit is held. Conversations without a row have zeros, an empty audit and the hash of no text.
    """
    kind = conversations.schema["conv"].dataType.simpleString()
    names = ["conv", "row", "number", "edit", "fault", "kind", "turn", "line"]
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text")).cast("binary")
    edits = repaired.withColumn("line", line).withColumn("turn", F.col("turn").cast("bigint")).select(*names)
    marks = conversations.select("conv", *[F.lit(None).cast(edits.schema[n].dataType).alias(n) for n in names[1:]])
    whole = edits.unionByName(marks).repartition("conv").sortWithinPartitions("conv", "row", "number")  # the mark comes first
    columns = ["gaps", *FAULTS[1:], "illegal", "cost"]
    schema = f"conv {kind}, " + ", ".join(f"{c} bigint" for c in columns) + ", audit string, repaired_sha256 string"
    own = {"R": REROLE, "D": DELETE, "I": INSERT, "K": 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, state = None, None

        def closed() -> pa.RecordBatch:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            values = [gaps, *(state[f] for f in FAULTS[1:]), state["illegal"], state["cost"]]
            out = {"conv": pa.array([state["conv"]], conv_type)} | {c: pa.array([v], pa.int64()) for c, v in zip(columns, values)}
            return pa.RecordBatch.from_pydict(out | {"audit": ["".join(state["audit"])], "repaired_sha256": [state["hash"].hexdigest()]})

        for batch in batches:
            conv_type = batch.column("conv").type
            for conv, row, _, edit, fault, role, turn, said in zip(*[batch.column(n).to_pylist() for n in names]):
                if row is None:
                    if state:
                        yield closed()
                    state = dict.fromkeys([*FAULTS[1:], "illegal", "cost", "turns", "low", "high"], 0)
                    state |= {"conv": conv, "audit": [], "hash": hashlib.sha256(), "lines": 0, "turn": None, "kind": None}
                    continue
                state["audit"].append(edit)
                state["cost"] += own[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "I":
                    state["illegal"] += state["kind"] is not None and (state["kind"], role) not in LEGAL
                    state["kind"] = role
                    if fault:
                        state[fault] += 1
                    if turn is not None and turn != state["turn"]:
                        state["low"] = turn if not state["turns"] else state["low"]
                        state["turn"], state["high"], state["turns"] = turn, turn, state["turns"] + 1
                if edit != "D":
                    state["hash"].update(b"\n" + said if state["lines"] else said)
                    state["lines"] += 1
        if state:
            yield closed()

    return whole.mapInArrow(run, schema)
