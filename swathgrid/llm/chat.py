r"""Chat formatting in budgeted windows.

A window holds the conversation's system turn, the last turns before its own as far as `history`
tokens reach, and its own turns; all together stay within `budget` tokens. Prefix sums of turn tokens choose
the spans: the turns whose tokens start in one stretch of 16 budgets are filled into windows in order, each up to
the last turn that still fits. Stretches are independent, so a long conversation is filled by many tasks; a
stretch's last window can be part empty. History gives way where a turn would not fit beside it.

A turn is written `<turn ROLE>TEXT</turn>`, a repeated one `<turn again ROLE>TEXT</turn>`, each on
its own line. Repeated turns stay outside the loss mask. Inside roles and texts, `\` becomes `\\`, `<` becomes
`\l`, `>` becomes `\g`, so no text can hold a control string, and the original comes back exactly.

Prefix sums are taken in blocks of 1024 turn numbers, then over the block sums, so a conversation
that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swathgrid.llm.common import WORD

BLOCK = 1024
MARKS = 4  # tokens that a turn's own marks are counted as
STRETCH = 16  # budgets that are filled in one go: 64 * budget turns at most


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    plain = {"\\": "\\", "l": "<", "g": ">"}
    return re.sub(r"\\(.)", lambda m: plain[m[1]], text) if "\\" in text else text


def prefix_sums(turns: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of `value` over all earlier turns of the conversation, in two levels."""
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inner = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.sum(value).alias("block_sum"))
    outer = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("block_sum").over(outer), F.lit(0)).alias("base"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    return (
        turns.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
        .join(blocks, same, "left")
        .withColumn(out, F.col(out) + F.coalesce("base", F.lit(0)))
        .drop("block", "base", "b_conv", "b_block")
    )


def chat_windows(conversations: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Formatted windows: conv_id, window (tokens before its own turns), text, mask (list of [start, end)
    code points of target text).

    Input columns: conv_id, turn, role, text; others are not read. Null text and null role are
    empty. A null conv_id is a conversation of its own, a null turn comes first. Ties in turn go by role, then text;
    rows that are equal in all of them are all kept. The system turn is the first of that role; it heads every
    window that starts after it. A window exceeds the budget only if one turn and the system turn alone do, as
    turns are never cut; it then has one own turn and no history. A role starting with "again " is kept by
    escaping its first letter's mark with `\\`. An empty table gives no windows.
    """
    length = STRETCH * budget
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + MARKS).cast("long"))
    placed = prefix_sums(turns, "tokens", "start").withColumn("stretch", F.floor(F.col("start") / length))
    # A stretch also sees the turns that its first window can repeat. A turn that reaches over a whole
    # stretch is longer than any history, so the stretch before is enough.
    seen = (F.col("stretch") + 1) * length - F.col("start") <= history
    at = F.array(F.col("stretch"), F.when(seen, F.col("stretch") + 1))
    rows = placed.withColumn("at", F.explode(F.filter(at, lambda x: x.isNotNull()))).select(
        "conv_id", "at", F.when(F.col("at") > F.col("stretch"), 1).otherwise(2).alias("part"), "start", "tokens", "role", "text"
    )
    systems = placed.filter(F.col("role") == "system").groupBy(F.col("conv_id").alias("s_conv"))
    systems = systems.agg(F.min(F.struct("start", "tokens", "text", "stretch")).alias("system"))
    stretches = placed.select("conv_id", F.col("stretch").alias("at")).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("at") >= F.col("system.stretch"))
    heads = stretches.join(systems, same).select(
        "conv_id", "at", F.lit(0).alias("part"), "system.start", "system.tokens", F.lit("system").alias("role"), "system.text"
    )
    return (
        rows.unionByName(heads)
        .repartition("conv_id", "at")
        .sortWithinPartitions("conv_id", "at", "part", "start")
        .mapInArrow(_filler(budget, history), "conv_id long, window long, text string, mask array<array<int>>")
    )


Turn = tuple[int, int, str, str]  # start, tokens, role, text


def _formatted(system: Turn | None, past: list[Turn], own: list[Turn]) -> tuple[str, list[list[int]]]:
    parts, mask, at = [], [], 0
    for turn in ([system] if system else []) + past + own:
        again = turn is system or turn[0] < own[0][0]
        role = escape(turn[2])
        head = f"<turn {'again ' if again else ''}{chr(92) if role.startswith('again ') else ''}{role}>"
        body = escape(turn[3])
        if not again and turn[2] == "assistant":
            mask.append([at + len(head), at + len(head) + len(body)])
        parts.append(f"{head}{body}</turn>\n")
        at += len(parts[-1])
    return "".join(parts), mask


def _filled(turns: Iterable[tuple[int, Turn]], budget: int, history: int) -> Iterator[tuple]:
    """(window, text, mask) of one stretch: its system turn (part 0), turns before it (1) and own turns (2), in order."""
    system: Turn | None = None
    head: Turn | None = None
    recent: deque[Turn] = deque()  # turns that end at most `history` tokens after their start
    past: list[Turn] = []
    own: list[Turn] = []
    room = 0
    for part, turn in turns:
        start, tokens = turn[:2]
        if part == 0:
            system = turn
            continue
        if part == 2 and (not own or start + tokens - own[0][0] > room):
            if own:
                yield own[0][0], *_formatted(head, past, own)
            head = system if system and system[0] < start else None
            left = budget - (head[1] if head else 0)
            reach = min(history, left - tokens)
            past = [t for t in recent if start - t[0] <= reach]
            room = left - (start - past[0][0] if past else 0)
            past = [t for t in past if not head or t[0] != head[0]]
            own = []
        if part == 2:
            own.append(turn)
        recent.append(turn)
        while recent and start + tokens - recent[0][0] > history:
            recent.popleft()
    if own:
        yield own[0][0], *_formatted(head, past, own)


def _filler(budget: int, history: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            conv, at, *rest = batch.columns
            for n in range(batch.num_rows):
                part, *turn = (c[n].as_py() for c in rest)
                yield (conv[n].as_py(), at[n].as_py()), (part, tuple(turn))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
        done: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "window", "text", "mask"])

        for (conv, _), group in groupby(rows(batches), key=itemgetter(0)):
            for window in _filled((x for _, x in group), budget, history):
                done.append((conv, *window))
                size += len(window[1])
                if size > 1 << 22:
                    yield flush()
                    done, size = [], 0
        if done:
            yield flush()

    return run


TURN = re.compile(r"<turn (again )?([^<>]*)>([^<>]*)</turn>\n")


def read_turns(text: str) -> Iterator[tuple[bool, str, str]]:
    """(repeated, role, text) of each turn of a formatted window."""
    for m in TURN.finditer(text):
        role = m[2][1:] if m[2].startswith("\\again ") else m[2]
        yield bool(m[1]), unescape(role), unescape(m[3])


def chat_digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows; see the query for the columns.

    A digest of a whole conversation is sequential by nature. It is taken over windows sorted on
    disk, one at a time, so memory stays small however long the conversation is.
    """

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        state: list = []

        def close():
            conv, n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not state or state[0] != conv:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for again, role, said in read_turns(text):
                    if not again:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for start, end in mask:
                    said = unescape(text[start:end])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(done) >= 1024:
                yield flush()
        if state:
            close()
        if done:
            yield flush()

    return (
        windows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "window")
        .select("conv_id", "text", "mask")
        .mapInArrow(
            digests,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )
