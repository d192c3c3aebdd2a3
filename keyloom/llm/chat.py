"""Chat formatting into budgeted windows.

A budget counts a tokenizer's tokens of the text written, template and escapes included.  A turn ends
with a newline and the next begins with ``<``, which no token of a byte-level model spans, so a
window's tokens are the sum of its turns'.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.tokens import Encoder

OPEN, SHUT = "<|turn|>", "<|end|>"
#: Strings that steer chat models; none is left whole inside an escaped text.
CONTROL = (OPEN, SHUT, "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(x) for x in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(SHUT) + r"\n", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    while (after := _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)) != text:
        text = after  # overlapping strings, as in <|>
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As ``escape``, for one line: a newline becomes backslash n (no control string has an n second)."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda m: "\n" if m[1] == "n" else m[1], role)


def written(role: str, text: str) -> tuple[str, str]:
    """(head, escaped text) of a turn; ``SHUT`` and a newline follow."""
    return f"{OPEN}{escape_role(role)}\n", escape(text)


def tokenizer_count(path: str) -> Callable[[str], int]:
    """Tokens of a string by a tokenizer file."""
    return lambda text: len(Encoder.of(path).ids(text)) // 4


OUT = "conv_id long, window int, text string, n_repeated int, tokens int, loss array<struct<start:int,end:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class _Windows:
    """The windows of one conversation, turn by turn; holds one window and its history."""

    def __init__(self, conv_id: int | None, budget: int, history: int, target: str, count: Callable[[str], int]) -> None:
        self.conv_id, self.budget, self.history, self.target, self.count = conv_id, budget, history, target, count
        self.system: tuple[str, str, str, int] | None = None  # role, head, escaped text, tokens
        self.past: list[tuple[str, str, str, int]] = []  # repeated turns of the open window
        self.new: list[tuple[str, str, str, int]] = []
        self.total = self.before = 0  # prefix sums of turn tokens: now, and where the open window starts
        self.made = self.seen = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        head, body = written(role, text)
        turn = (role, head, body, self.count(f"{head}{body}{SHUT}\n"))
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = turn
            self.new.append(turn)
            return
        fixed = (self.system[3] if self.system else 0) + sum(x[3] for x in self.past)
        if any(x is not self.system for x in self.new) and fixed + self.total + turn[3] - self.before > self.budget:
            done = [x for x in self.past + self.new if x is not self.system]
            yield self.close()
            room = min(self.history, self.budget - (self.system[3] if self.system else 0) - turn[3])
            self.past = []
            for x in reversed(done):
                room -= x[3]
                if room < 0:
                    break
                self.past.insert(0, x)
            self.before = self.total
        self.new.append(turn)
        self.total += turn[3]

    def close(self) -> tuple:
        again = ([self.system] if self.system and self.made else []) + self.past
        out, spans, at = [], [], 0
        for i, (role, head, body, _) in enumerate(again + self.new):
            if i >= len(again) and role == self.target and body:
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            out.append(f"{head}{body}{SHUT}\n")
            at += len(out[-1])
        row = (self.conv_id, self.made, "".join(out), len(again), sum(x[3] for x in again + self.new), spans)
        self.made, self.new = self.made + 1, []
        return row


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), _LOSS)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "window", "text", "n_repeated", "tokens", "loss"])


def format_windows(turns: DataFrame, count: Callable[[str], int], budget: int = 512, history: int = 128, target: str = "assistant") -> DataFrame:
    """Format conversations as windows of whole turns within a token budget.

    ``turns`` has conv_id, turn, role, text; ``count`` gives the tokens of a written turn (see
    ``tokenizer_count``).  Prefix sums of turn tokens cut each conversation where the system turn, the
    repeated history and the new turns would pass ``budget``; a turn that is longer alone has a window
    of its own, whole.  Each window repeats the system turn (a conversation's first turn of role
    ``system``) and the last whole turns before it within ``history`` tokens; repeated turns carry
    no loss, so each ``target`` text is under the loss mask once over all windows.  Texts and roles
    are escaped, so no control string in them survives, and ``parse`` restores them.

    Turns of a conversation stream through one task that holds one window, however many there are.
    Null text or role: empty.  Null conv_id: a conversation of its own.  Null turn: before all others.
    Equal turn numbers: ordered by role, then text; repeated rows are turns of their own.  Other
    columns are not read, so none clashes.  Empty input: no windows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Windows | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        out.append(state.close())
                    state = _Windows(conv_id, budget, history, target, count)
                out += state.add(role, text)
            if out:
                yield _batch(out)
        if state is not None:
            yield _batch([state.close()])

    return rows.mapInArrow(run, OUT)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def digest(windows: DataFrame, target: str = "assistant") -> DataFrame:
    """What each conversation's windows say, read back from their text and loss spans alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows), the last
    two over all windows, repeated turns included.  Windows of a conversation stream through one task
    in order, since a digest is sequential; a task holds one of them.  Null conv_id: a conversation of
    its own.  Other columns are not read, so none clashes.  Empty input: empty result.
    """
    rows = windows.select("conv_id", "window", "text", "n_repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        state: list | None = None

        def ended(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]

        for batch in batches:
            done = []
            for conv_id, text, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        done.append(ended(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(ended(state), types, strict=True)], names=names)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
