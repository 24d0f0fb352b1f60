"""Chat formatting into budgeted windows with a loss mask.

A conversation's turns go, in order, into windows of at most `budget` tokens. Prefix sums of
the turns' token counts choose where a window ends, always between turns. Each window after
the first repeats the leading system turn and as many of the turns before it as fit into
`history` tokens; repeated turns carry no loss, so each assistant text is trained on once.
A single turn beyond the budget has a window for itself and is not cut.

A turn is written as <s>[INST]role[/INST]text</s>. Control strings inside a role or text
are broken up by a backslash after their first character, and backslashes are doubled, so
nothing in a text can end its turn, and unescape() gives the text back.

Null texts and roles are empty. Turns are ordered by (turn, role, text), nulls first; repeated
rows are turns each for itself; rows without a conversation id make one conversation.
Conversations are dealt by id, sorted and read as a stream: a task holds one window, however
long a conversation is.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import of

#: The template's control strings and those of its family.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET, HISTORY = 1024, 256
WINDOW = "conv_id long, window int, n_repeated int, formatted string, loss array<struct<start:int,stop:int>>"
_control = re.compile("|".join(map(re.escape, CONTROL)))
_mark = re.compile(r"\\(\\?)")
_turn = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_token = re.compile(r"\w{1,4}|[^\w\s]")


def escape(text: str) -> str:
    return _control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _mark.sub(r"\1", text)


def tokens(text: str) -> int:
    """Tokens a turn is taken for: up to four letters or digits, or a mark, each; 4 for the template."""
    return 4 + sum(1 for _ in _token.finditer(text))


class Windows:
    """Chooses the windows of one conversation, turn by turn."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.turns: list[tuple[str, str, int]] = []  # of the open window, repeated ones first
        self.repeated, self.number, self.first = 0, 0, True
        self.sums = [0]

    def add(self, role: str, text: str):
        turn = (role, text, tokens(text))
        if self.first and role == "system":
            self.system = turn
        self.first = False
        if self.sums[-1] + turn[2] > self.budget and len(self.turns) > self.repeated:
            yield self.close()
            lead = [self.system] if self.system else []
            room = min(self.history, self.budget - turn[2] - sum(t[2] for t in lead))
            body = self.turns[1:] if lead and self.turns[:1] == lead else self.turns
            total, k = self.sums[-1], len(self.turns)
            while k > len(self.turns) - len(body) and total - self.sums[k - 1] <= room:
                k -= 1
            self.turns = lead + self.turns[k:]
            self.repeated = len(self.turns)
            self.sums = [0]
            for t in self.turns:
                self.sums.append(self.sums[-1] + t[2])
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(self.turns):
            head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
            if role == "assistant" and i >= self.repeated:
                loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
            parts.append(f"{head}{body}</s>")
            at += len(parts[-1])
        self.number += 1
        return self.conv, self.number - 1, self.repeated, "".join(parts), loss


def _formatted(budget: int, history: int):
    def batch(rows):
        conv, number, repeated, text, loss = zip(*rows)
        spans = pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(number, pa.int32()), pa.array(repeated, pa.int32()), pa.array(text, pa.string()), spans], ["conv_id", "window", "n_repeated", "formatted", "loss"])

    def run(batches):
        rows, open_ = [], None
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if open_ is None or open_.conv != conv:
                    rows += [open_.close()] if open_ else []
                    open_ = Windows(conv, budget, history)
                rows += open_.add(role or "", text or "")
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
        rows += [open_.close()] if open_ else []
        if rows:
            yield batch(rows)

    return run


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows (conv_id, window, n_repeated, formatted, loss) of rows (conv_id, turn, role, text).

    loss: spans of `formatted`, in code points, that a model is trained on. Windows of a
    conversation follow each other in their partition.
    """
    t = of(turns, conv_id="long", turn="long", role="string", text="string")
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.select("conv_id", "role", "text").mapInArrow(_formatted(budget, history), WINDOW)


def _read_back(batches):
    titles = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows, open_ = [], None

    def done():
        conv, n, turns, chars, loss, formatted, _ = open_
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if "sha" in t else pa.int64()) for t, v in zip(titles, zip(*rows))], titles)

    for b in batches:
        for conv, number, repeated, text, spans in zip(*(b.column(i).to_pylist() for i in range(5))):
            if open_ is None or number == 0:
                rows += [done()] if open_ else []
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
            for role, body in _turn.findall(text)[repeated:]:
                open_[1] += 1
                open_[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            for s in spans:
                said = unescape(text[s["start"] : s["stop"]])
                open_[3] += len(said)
                open_[4].update(said.encode())
            open_[5] += len(text)
        if len(rows) >= 1000:
            yield batch(rows)
            rows = []
    rows += [done()] if open_ else []
    if rows:
        yield batch(rows)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from windows in order: turns, loss text and sizes, as counts and digests."""
    return windows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def stored_windows(windows: DataFrame) -> DataFrame:
    """Windows read from a table, put back in order for read_back()."""
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")


def with_control_case(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return of(turns, conv_id="long", turn="long", role="string", text="string").unionByName(extra)
