"""Chat formatting: turn-aligned windows under a token budget, with a loss mask and a reversible template.

Turns of a conversation come in order through one task, a batch at a time; only the turns of one
window are held, so a conversation may be of any length.  Prefix sums of turn tokens choose each
window's last turn.  A window repeats the conversation's system turn, which is its first turn if that has
the role ``system``, and as many whole turns before it as ``history`` tokens allow; repeated turns are
marked and never under the loss mask.  The system turn is repeated whatever its length: history gives way
first, and where the next turn still exceeds the budget it is the only new turn of a longer window.

Template: ``<s>[INST] role``, a line break, the text, ``</s>`` for each turn; repeated turns have
``[HIST]`` instead.  Inside roles and texts a backslash is doubled and one is put after the first
character of every control string, so no control string is left there; ``unescape`` reverses it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.tokens import word_tokens

BUDGET, HISTORY = 1024, 256
#: Tokens that the template adds to a turn.
FRAME = 6

NEW, PAST, OPEN, CLOSE = "[INST] ", "[HIST] ", "<s>", "</s>"
# Control strings of this and other common templates; none is left inside a text.
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|\[/?HIST\]|<</?SYS>>|<\|(?:im_start|im_end|system|user|assistant|end|endoftext|startoftext)\|>")
_TURN = re.compile(r"<s>\[(INST|HIST)\] ((?:[^\n\\]|\\.)*?)\n((?:[^\\]|\\.)*?)</s>", re.DOTALL)


def escape(text: str, line: bool = False) -> str:
    """Break up control strings; ``line`` also protects line breaks."""
    out = CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)
    return out.replace("\n", "\\\n") if line else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def read_back(window: str) -> list[tuple[bool, str, str]]:
    """(repeated, role, text) of each turn of a formatted window."""
    return [(m[1] == "HIST", unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(window)]


class _Conversation:
    """Turns of one conversation that still matter: the system turn, history, and the next window's."""

    def __init__(self, name, budget: int, history: int):
        self.name, self.budget, self.history = name, budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]
        self.window = self.first = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens + FRAME)
        if self.sums[-1] > self.room():
            yield from self.flush(False)

    def room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0) - sum(t[2] for t in self.past)

    def flush(self, end: bool) -> Iterator[dict]:
        """Windows of the turns that are sure to fit no further turn; all of them at the end."""
        while self.turns and (end or self.sums[-1] > self.room()):
            if self.past and self.sums[1] > self.room():
                self.past.pop(0)
                continue
            number = max(1, bisect_right(self.sums, self.room()) - 1)
            yield self._format(number)
            done = [(*t, b - a) for t, a, b in zip(self.turns[:number], self.sums, self.sums[1:], strict=False)]
            if self.system is None and self.first == 0 and done[0][0] == "system":
                self.system = done.pop(0)
            self.past = self.past + done
            kept, total = [], 0
            for turn in reversed(self.past):
                total += turn[2]
                if total > self.history:
                    break
                kept.append(turn)
            self.past = kept[::-1]
            self.first += number
            self.turns = self.turns[number:]
            base = self.sums[number]
            self.sums = [s - base for s in self.sums[number:]]

    def _format(self, number: int) -> dict:
        parts, at, loss = [], 0, []
        repeated = ([self.system] if self.system else []) + self.past
        for old, (role, text) in [(True, t[:2]) for t in repeated] + [(False, t) for t in self.turns[:number]]:
            head = f"{OPEN}{PAST if old else NEW}{escape(role, True)}\n"
            body = escape(text)
            if role == "assistant" and not old:
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        row = {"conv_id": self.name, "window": self.window, "first_turn": self.first, "n_turns": number, "n_repeated": len(repeated)}
        row |= {"n_tokens": self.sums[number] + self.budget - self.room(), "text": "".join(parts), "loss": loss}
        self.window += 1
        return row


_WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_turns", pa.int64()), ("n_repeated", pa.int64()),
    ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
_WINDOW_SCHEMA = "conv_id long, window int, first_turn long, n_turns long, n_repeated long, n_tokens long, text string, loss array<struct<start:long,end:long>>"


def _windows(tokenizer: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, talk, out = word_tokens(tokenizer).encode, None, []
        for batch in batches:
            names, roles, texts = (batch.column(c).to_pylist() for c in range(3))
            texts = [t or "" for t in texts]
            lengths = count([t.encode() for t in texts])[1].tolist() if texts else []
            for name, role, text, tokens in zip(names, roles, texts, lengths, strict=True):
                if talk is None or name != talk.name:
                    if talk is not None:
                        out.extend(talk.flush(True))
                    talk = _Conversation(name, budget, history)
                out.extend(talk.add(role or "", text, tokens))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_WINDOWS)
                out = []
        if talk is not None:
            yield pa.RecordBatch.from_pylist(list(talk.flush(True)), schema=_WINDOWS)

    return run


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text), each conversation's in order within one partition.

    Columns: conv_id, window, first_turn, n_turns (new ones), n_repeated, n_tokens, text, and loss,
    the spans of characters of ``text`` that are new assistant texts.

    Defined cases: null and empty texts are empty turns; a null role is the role ''; equal turn
    numbers come in order of role and text, a null turn first; repeated rows are repeated turns; rows
    of a null conv_id are one conversation; an empty table gives an empty table; other columns are
    left out.
    """
    ordered = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_windows(tokenizer, budget, history), _WINDOW_SCHEMA)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


class _Digest:
    def __init__(self, name):
        self.name, self.turns, self.loss = name, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, spans: list[dict]) -> None:
        self.windows += 1
        self.chars += len(text)
        for old, role, body in read_back(text):
            if not old:
                self.n_turns += 1
                self.turns.update(f"{role}\n{body}\n".encode())
        for span in spans:
            body = unescape(text[span["start"]: span["end"]])
            self.loss_chars += len(body)
            self.loss.update(body.encode())

    def row(self) -> dict:
        return dict(zip(_DIGEST.names, (self.name, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows), strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    talk = None
    for batch in batches:
        out = []
        for name, text, loss in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if talk is None or name != talk.name:
                if talk is not None:
                    out.append(talk.row())
                talk = _Digest(name)
            talk.add(text, loss)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
    if talk is not None:
        yield pa.RecordBatch.from_pylist([talk.row()], schema=_DIGEST)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say when read back: turns, texts under the loss mask, sizes.

    ``windows`` must come straight from ``format_windows``, which keeps a conversation's in order.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.select("conv_id", "text", "loss").mapInArrow(_digests, schema)
