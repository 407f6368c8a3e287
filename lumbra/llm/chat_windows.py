"""Chat formatting: budgeted windows over conversations.

A turn is written ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash is put before backslashes,
before each ``#`` of a run of three or more and inside ``</turn>``, and before ``:`` in roles; dropping one backslash of each pair
gives the original back, so no text can imitate a mark.

The prefix sums of the written turns' token counts choose the windows: a window starts at the first turn not yet written, and
ends before the turn whose prefix sum goes beyond the budget left by its context. The context repeats the system turn that opens the
conversation and at most ``HISTORY`` turns, the latest ones, that take at most ``HISTORY_SHARE`` of the budget. Spans are always whole
turns; a turn that fits only without the system turn has a window without it, and a system turn over the budget isn't repeated, so only a turn that is itself larger than the budget
makes a window exceed it. Only assistant texts that are new in a window are under the loss
mask; repeated turns are masked. Rows are sorted by conversation and turn and streamed, so only a window's turns are in memory.

Defined results: null texts and roles are empty; null turns come first; turns with the same number are ordered by role
and text; repeated rows are turns of their own; rows without a conversation id form one conversation; an empty table gives no
windows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 4
HISTORY_SHARE = 0.25
_END = "</turn>\n"
_SIGNS = re.compile(r"\\|#{3,}|</turn>")
_PAIR = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
WINDOWS = "conv_id bigint, window bigint, context_turns int, turns int, tokens bigint, text string, loss array<struct<start:bigint,stop:bigint>>"
BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _SIGNS.sub(lambda m: "\\\\" if m[0] == "\\" else "<\\/turn>" if m[0][0] == "<" else "\\#" * len(m[0]), text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its text starts and stops."""
    head = "### " + escape(role).replace(":", "\\:") + ": "
    body = escape(text)
    return head + body + _END, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each written turn."""
    out, at = [], 0
    while at < len(text):
        head = _TURN.match(text, at)
        stop = text.index(_END, head.end())
        out.append((unescape(head[1]), unescape(text[head.end() : stop])))
        at = stop + len(_END)
    return out


class Windows:
    """Turns of one conversation in, windows out."""

    def __init__(self, conv, budget: int):
        self.conv, self.budget, self.number = conv, budget, 0
        self.system: tuple[str, int] | None = None  # written turn, tokens
        self.history: deque[tuple[str, int]] = deque(maxlen=HISTORY)
        self.sum = 0  # prefix sum of the tokens of all turns so far
        self.any = False
        self._start()

    def _start(self, alone: bool = False) -> None:
        room, kept = self.budget * HISTORY_SHARE, []
        for turn in reversed(self.history):
            room -= turn[1]
            if room < 0:
                break
            kept.append(turn)
        context = ([self.system] if self.system and not alone else []) + kept[::-1]
        self.parts = [t for t, _ in context]
        self.context = len(context)
        self.base = self.sum - sum(n for _, n in context)  # the window holds what the prefix sum has beyond this
        self.new, self.loss = 0, []
        self.at = sum(map(len, self.parts))

    def add(self, role: str, text: str, tokens: int):
        """The window that this turn completes by not fitting into it, if any."""
        done = None
        if self.new and self.sum + tokens - self.base > self.budget:
            done = self.close()
            self._start()
        if self.context and not self.new and self.sum + tokens - self.base > self.budget:  # context gives way, the system turn last
            self.history.clear()
            self._start()
            if self.system and self.sum + tokens - self.base > self.budget and (tokens <= self.budget or self.system[1] > self.budget):
                self._start(alone=True)
        written, start, stop = format_turn(role, text)
        self.parts.append(written)
        if role == "assistant":
            self.loss.append({"start": self.at + start, "stop": self.at + stop})
        self.at += len(written)
        self.sum += tokens
        self.new += 1
        if not self.any and role == "system":
            self.system = (written, tokens)
        else:
            self.history.append((written, tokens))
        self.any = True
        return done

    def close(self):
        got = (self.conv, self.number, self.context, self.context + self.new, self.sum - self.base, "".join(self.parts), self.loss)
        self.number += 1
        return got


def windows(conversations: DataFrame, encoder_of, budget: int = BUDGET) -> DataFrame:
    """The windows of every conversation, each conversation's together and in order. ``encoder_of()`` gives an object whose ``ids(text)`` counts tokens."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encoder, own, out = encoder_of(), None, []
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("context_turns", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

        def flush():
            got = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out.clear()
            return got

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if own is None or own.conv != conv:
                    if own is not None:
                        out.append(own.close())
                    own = Windows(conv, budget)
                done = own.add(role, text, len(encoder.ids(format_turn(role, text)[0])))
                if done:
                    out.append(done)
            if len(out) >= 500:
                yield flush()
        if own is not None:
            out.append(own.close())
        yield flush()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from ``windows`` as they stand in their partitions."""

    def run(batches):
        conv, started, out = None, False, []
        turns = loss = None
        n = loss_chars = chars = 0

        def close():
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for r in batch.to_pylist():
                if not started or r["conv_id"] != conv or r["window"] == 0:
                    if started:
                        close()
                    conv, started = r["conv_id"], True
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
                for role, text in parse(r["text"])[r["context_turns"] :]:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                    n += 1
                for span in r["loss"]:
                    text = unescape(r["text"][span["start"] : span["stop"]])
                    loss.update(text.encode("utf-8", "replace"))
                    loss_chars += len(text)
                chars += len(r["text"])
            if len(out) >= 2000:
                yield flush()
        if started:
            close()
        yield flush()

    return formatted.mapInArrow(run, BACK)
