"""Chat formatting in budgeted windows.

A conversation becomes training texts of at most ``budget`` tokens of a given tokenizer, cut between turns. The running
sum of turn tokens decides where a window ends. Each window after the first starts with the conversation's system turn and the last few
turns again; what is repeated is never under the loss mask, so each assistant text is learned once.

Turns are dealt by conversation, sorted, and read as a stream: a worker keeps one window and the limited history,
however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexispark.llm.common import small_batches
from lexispark.llm.packing import encoder

OPEN, CLOSE = "### ", " </turn>\n"
WINDOW = ["conv_id", "window_no", "text", "n_tokens", "n_turns", "n_repeated", "loss"]


def escape(text: str) -> str:
    """Put a backslash before each backslash and each character that begins a control string or ends a role."""
    return re.sub(r"[\\#<:]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, with the span of its own text in it."""
    head, body = f"{OPEN}{escape(role)}: ", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


TURN = re.compile(r"(?s)### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<#])*) </turn>\n")


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a window, unescaped; the inverse of ``render`` over a whole window."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Window:
    """The window that is being filled."""

    def __init__(self, conv: object, budget: int, history_turns: int, history_tokens: int):
        self.conv, self.budget, self.no = conv, budget, 0
        self.most = history_turns, history_tokens
        self.system: tuple | None = None
        self.history: list[tuple] = []
        self.turns: list[tuple] = []
        self.prefix = [0]
        self.repeated = 0

    def add(self, role: str, shown: str, a: int, b: int, tokens: int) -> Iterator[tuple]:
        """A turn as ``render`` gives it, with its tokens; yields the window that it ends, if it ends one."""
        turn = (role, shown, a, b, tokens)
        if len(self.turns) > self.repeated and self.prefix[-1] + turn[4] > self.budget:
            yield self.close()
            keep = [self.system] if self.system else []
            room = self.budget - turn[4] - sum(t[4] for t in keep)
            last: list[tuple] = []
            for t in reversed(self.history):
                if t is self.system or len(last) == self.most[0] or sum(x[4] for x in last) + t[4] > min(room, self.most[1]):
                    break
                last.insert(0, t)
            self.turns, self.prefix = [], [0]
            for t in keep + last:
                self.turns.append(t)
                self.prefix.append(self.prefix[-1] + t[4])
            self.repeated = len(self.turns)
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + turn[4])
        if role == "system" and self.system is None:
            self.system = turn
        self.history = [*self.history, turn][-max(1, self.most[0]) :]

    def close(self) -> tuple:
        at, loss, parts = 0, [], []
        for k, (role, shown, a, b, _) in enumerate(self.turns):
            if role == "assistant" and k >= self.repeated:
                loss.append([at + a, at + b])
            parts.append(shown)
            at += len(shown)
        self.no += 1
        return self.conv, self.no - 1, "".join(parts), self.prefix[-1], len(self.turns), self.repeated, loss


def format_chats(
    turns: DataFrame, tokenizer: str, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256
) -> DataFrame:
    """Windows of conversations given as rows (conv_id, turn, role, text); other columns are ignored.

    Returns a row per window: conv_id, window_no, its text, its tokens (those that the byte-level BPE file ``tokenizer``
    gives its turns as they are shown, one by one), how many turns it has, how many of the first ones are repeated, and
    the loss spans in code points. Turns are ordered by turn, then role, then text, so ties have one order; repeated rows
    are turns of their own. Null roles and texts are empty strings. Ids of any type are kept; rows with a null conv_id
    form one conversation. A turn above the budget has a window of its own, longer than the budget, after the system
    turn; a very long text is such a turn. No rows give no windows.

    A conversation's turns are read by one task, in order; it holds one window and the limited history.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    schema = f"conv_id {kind}, window_no int, text string, n_tokens int, n_turns int, n_repeated int, loss array<array<int>>"
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        now: _Window | None = None
        for batch in batches:
            out = []
            convs, _, roles, texts = (c.to_pylist() for c in batch.columns)
            shown = [render(role, text) for role, text in zip(roles, texts, strict=True)]
            tokens = [len(i) for i in enc.many([s for s, _, _ in shown])]
            for conv, role, (text, a, b), n in zip(convs, roles, shown, tokens, strict=True):
                if now is None or now.conv != conv:
                    if now:
                        out.append(now.close())
                    now = _Window(conv, budget, history_turns, history_tokens)
                out.extend(now.add(role, text, a, b, n))
            yield _rows(out, types)
        if now:
            yield _rows([now.close()], types)

    return rows.mapInArrow(run, schema)


def _rows(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of whole conversations, read from the windows of ``format_chats``, in whatever order they are stored.

    One row per conversation: n_turns, turns_sha256 over role, newline, text, newline of each turn once, loss_chars
    and loss_sha256 over the unescaped text under the loss mask, and formatted_chars over all windows. A digest is
    sequential, so a conversation's windows are read by one task, as a stream in the order of their numbers; it keeps
    two running hashes. No windows give no rows; other columns are ignored.
    """
    small_batches(windows.sparkSession)
    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = windows.select("conv_id", "window_no", "text", "n_repeated", "loss").repartition(
        "conv_id"
    ).sortWithinPartitions("conv_id", "window_no")

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def done(x: dict) -> tuple:
            return x["conv"], x["n"], x["turns"].hexdigest(), x["chars"], x["loss"].hexdigest(), x["all"]

        for batch in batches:
            out = []
            for conv, no, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if no == 0:
                    if now:
                        out.append(done(now))
                    now = {
                        "conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0
                    }
                for role, said in read_turns(text)[repeated:]:
                    now["turns"].update(f"{role}\n{said}\n".encode())
                    now["n"] += 1
                for a, b in loss:
                    said = unescape(text[a:b])
                    now["loss"].update(said.encode())
                    now["chars"] += len(said)
                now["all"] += len(text)
            yield _rows(out, types)
        if now:
            yield _rows([done(now)], types)

    return rows.mapInArrow(run, schema)
