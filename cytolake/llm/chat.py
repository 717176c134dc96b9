"""Chat formatting in windows of a token budget.

A turn is written as ``<turn:role>role<turn:text>text</turn>`` and a line end. Control strings all begin with ``<turn`` or
``</turn``; inside roles and texts a backslash breaks these up and is itself doubled, so no control string
stands in a text and every text can be restored.

Long conversations become windows. Prefix sums of the turns' tokens lay all turns on one line; the line is cut into
cells of half the budget and a window holds the turns that begin in a cell, so a window's new turns follow from
the sums alone. A turn that crosses the end of its cell and does not fit gets a window of its own. Each window repeats the
system turn and, as far as there is room, the turns just before it; only an assistant's text that is new in a
window is under the loss mask, so each is a target exactly once.

Prefix sums are built from sums of short runs of turns, so a conversation that makes up a third of the table is
spread over many tasks.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm.mixing import size_column
from cytolake.runtime import cut

ROLE, TEXT, CLOSE = "<turn:role>", "<turn:text>", "</turn>\n"
#: tokens a turn's control strings count for
MARKS = 3
#: turns of a run
RUN = 64


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<turn"), F.lit("<\\turn")), F.lit("</turn"), F.lit("<\\/turn"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_tokens(role: Column, text: Column) -> Column:
    """Words of the role and the text, and the marks around them."""
    return size_column(role) + size_column(text) + F.lit(MARKS)


def placed_turns(turns: DataFrame) -> DataFrame:
    """``(conv, position, role, text, tokens, before)``: place in the conversation and tokens of all turns before.

    ``turns`` is ``(conv, turn, role, text)`` without null texts and roles.
    """
    run = F.floor(F.col("turn") / RUN)
    rows = turns.withColumn("run", run).withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))
    within = Window.partitionBy("conv", "run").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    runs = rows.groupBy("conv", "run").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).select(
        F.struct("conv", "run").alias("of"),
        F.coalesce(F.sum("t").over(earlier), zero).alias("t_before"), F.coalesce(F.sum("n").over(earlier), zero).alias("n_before"),
    )
    own = rows.select(
        "*", F.struct("conv", "run").alias("key"),
        F.coalesce(F.sum("tokens").over(within), zero).alias("t_own"), F.count(F.lit(1)).over(within).alias("n_own"),
    )
    return own.join(runs, F.col("key").eqNullSafe(F.col("of"))).select(
        "conv", (F.col("n_before") + F.col("n_own")).alias("position"), "role", "text", "tokens",
        (F.col("t_before") + F.col("t_own")).alias("before"),
    )


def chat_windows(
    conversations: DataFrame,
    budget: int = 2048,
    history: int = 256,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``(conv_id, window, text, targets, n_turns, n_repeated, n_tokens)``.

    ``text`` is the formatted window, ``targets`` are the spans ``(begin, end)`` of its code points under the loss mask, and
    ``n_repeated`` of its ``n_turns`` turns, the first ones, have stood in an earlier window. A window keeps to the budget
    unless the system turn and one turn alone exceed it. Turns are in order of their number, null first; equal
    numbers are in order of role and text, and repeated rows are turns like any other. Null texts and roles are empty;
    a null conversation id is a conversation of its own; an empty table gives an empty result. Only a
    system turn that comes first is repeated. Other columns are not read.
    """
    empty = F.lit("")
    turns = conversations.select(
        F.col(id_column).alias("conv"), F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), empty).alias("role"), F.coalesce(F.col(text_column), empty).alias("text"),
    )
    placed = cut(placed_turns(turns))  # read for the system turns and for all others
    is_system = (F.col("position") == 0) & (F.col("role") == "system")
    system = placed.where(is_system).select(F.col("conv").alias("of"), F.struct("role", "text").alias("system"), F.col("tokens").alias("s"))
    rows = placed.join(system, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of").withColumn("s", F.coalesce("s", F.lit(0).cast("bigint")))
    rows = rows.withColumn("room", F.greatest(F.lit(budget) - F.col("s"), F.lit(2).cast("bigint")))
    rows = rows.withColumn("cell_width", F.floor(F.col("room") / 2)).withColumn("start", F.greatest(F.col("before") - F.col("s"), F.lit(0).cast("bigint")))
    is_new_system = is_system & F.col("system").isNotNull()
    body = rows.where(~is_new_system).withColumn("cell", F.floor(F.col("start") / F.col("cell_width"))).withColumn("end", F.col("start") + F.col("tokens"))
    cell = Window.partitionBy("conv", "cell")  # at most half a budget of turns
    body = body.withColumn("cell_start", F.min("start").over(cell))
    crosses = (F.col("end") > (F.col("cell") + 1) * F.col("cell_width")) & (F.col("start") > F.col("cell_start"))
    alone = crosses & (F.col("end") - F.col("cell_start") > F.col("room"))
    body = cut(body.withColumn("window", 2 * F.col("cell") + F.when(alone, 1).otherwise(0)))

    turn = lambda repeated: F.struct("position", F.lit(repeated).alias("repeated"), "role", "text", "tokens").alias("item")
    new = body.select("conv", "window", turn(False))
    windows = body.groupBy("conv", "window").agg(
        F.sum("tokens").alias("new"), F.min("start").alias("from"), F.first("room").alias("room"), F.first("cell_width").alias("width"),
        F.first("system").alias("system"), F.first("s").alias("s"),
    )
    reach = F.least(F.lit(history).cast("bigint"), F.col("room") - F.col("new"), F.col("from"))
    back = windows.withColumn("reach", reach).where("reach > 0").select(
        F.col("conv").alias("of"), "window", "from", "reach",
        F.explode(F.sequence(F.floor((F.col("from") - F.col("reach")) / F.col("width")), F.floor((F.col("from") - 1) / F.col("width")))).alias("back"),
    )
    repeated = body.drop("window").join(back, F.col("conv").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("back"))).where(
        (F.col("start") >= F.col("from") - F.col("reach")) & (F.col("end") <= F.col("from"))
    ).select("conv", "window", turn(True))
    first_system = rows.where(is_new_system).select("conv", F.lit(0).cast("bigint").alias("window"), turn(False))
    again = windows.where("window > 0 and system is not null").select(
        "conv", "window",
        F.struct(F.lit(0).cast("bigint").alias("position"), F.lit(True).alias("repeated"), F.col("system.role").alias("role"),
                 F.col("system.text").alias("text"), F.col("s").alias("tokens")).alias("item"),
    )
    every = new.unionByName(repeated).unionByName(first_system).unionByName(again)
    grouped = every.groupBy("conv", "window").agg(F.sort_array(F.collect_list("item")).alias("items"))  # one window's turns
    written = F.transform(
        "items",
        lambda t: F.struct(
            F.concat(F.lit(ROLE), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body"),
            ((t["role"] == "assistant") & ~t["repeated"]).alias("target"),
        ),
    )
    spans = F.expr(
        "aggregate(written, struct(0L as at, cast(array() as array<struct<begin: bigint, end: bigint>>) as spans), (a, t) -> struct("
        f"a.at + length(t.head) + length(t.body) + {len(CLOSE)} as at,"
        "if(t.target, array_append(a.spans, struct(a.at + length(t.head) as begin, a.at + length(t.head) + length(t.body) as end)), a.spans) as spans)).spans"
    )
    return grouped.withColumn("written", written).select(
        F.col("conv").alias("conv_id"), "window",
        F.array_join(F.transform("written", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("text"),
        spans.alias("targets"), F.size("items").alias("n_turns"),
        F.size(F.filter("items", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def parse_window(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window, as they were before escaping."""
    out = []
    for turn in text.split(CLOSE)[:-1]:
        role, body = turn.removeprefix(ROLE).split(TEXT)
        out.append((unescaped(role), unescaped(body)))
    return out


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Whole conversations read back from their windows, as digests.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Windows of a conversation pass
    one after another through running hashes; none is kept.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def close() -> None:
            done.append((at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "text", "targets", "n_repeated")]
            for conv, text, targets, repeated in zip(*columns):
                if at is None or at[0] != conv:
                    if at is not None:
                        close()
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_window(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in targets:
                    target = unescaped(text[span["begin"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)
            done = []
        if at is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)

    ordered = windows.select("conv_id", "window", "text", "targets", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
