"""Chat formatting: typed content parts, reversible escapes, loss masks, attachments.

A turn is rendered as  <|turn|>role NEWLINE body<|end|> NEWLINE. A visitor
flattens the parts of its content in order: text is escaped, each image, audio,
document and other part becomes a placeholder <|kind:n|>, n counting attachments of the
turn, and its reference and the tokens that it expands to are recorded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import slices, words

#: Strings that control chat templates; "<|" begins all of its kind.
CONTROL = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
_BEFORE = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)
_SEGMENT = re.compile(r"<\|turn\|>.*?<\|end\|>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document|other):(\d+)\|>")

#: Pixels of an image patch's side, audio frames per second and tokens per document page.
PATCH, FRAMES, PAGE = 28, 25, 800

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHMENT = "array<struct<kind: string, ref: string, place: long, tokens: long>>"
FORMATTED = f"conv_id long, turn long, role string, segment string, loss_start long, loss_end long, attachments {ATTACHMENT}, n_tokens long"


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _BEFORE.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn and collects its body and attachments."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.tokens = self.length = 0

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self._add(escape(text))
        self.tokens += len(words(text.encode()))

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * FRAMES))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach(part, 1, "other")

    def _attach(self, part: dict, tokens: int, mark: str | None = None) -> None:
        place = self.length
        self._add(f"<|{mark or part['type']}:{len(self.attachments)}|>")
        self.attachments.append({"kind": part["type"], "ref": part["ref"], "place": place, "tokens": max(1, tokens)})
        self.tokens += max(1, tokens)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


def render(role: str | None, parts: list[dict]) -> dict:
    """segment, loss_start, loss_end, attachments and n_tokens of one turn; only assistants have a loss span.

    A null part is left out, a part of null type is text, a null size counts as
    0. A part of an unknown type is an attachment of that kind and one token,
    with a placeholder of its own.
    """
    flat = Flatten()
    for part in parts:
        flat.visit(part)
    head = "<|turn|>" + escape(role or "").replace("\n", "\\n") + "\n"
    loss = (len(head), len(head) + flat.length) if role == "assistant" else (None, None)
    attached = [a | {"place": a["place"] + len(head)} for a in flat.attachments]
    return {"segment": head + "".join(flat.out) + "<|end|>\n", "loss_start": loss[0], "loss_end": loss[1], "attachments": attached, "n_tokens": flat.tokens}


def parse(segment: str) -> tuple[str, list[str]]:
    """The role of a rendered turn, and its body as text and placeholders in turn (text first and last)."""
    role, body = _TURN.fullmatch(segment).groups()
    role = _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)
    out, last = [], 0
    for m in _PLACEHOLDER.finditer(body):
        out += [unescape(body[last : m.start()]), m[0]]
        last = m.end()
    return role, [*out, unescape(body[last:])]


def parse_conversation(text: str) -> list[tuple[str, list[str]]]:
    """parse() of each turn of a whole formatted conversation: no text inside holds an unescaped mark."""
    return [parse(x) for x in _SEGMENT.findall(text)]


def format_turns(messages: DataFrame) -> DataFrame:
    """FORMATTED: a row per row of ``messages`` (conv_id, turn, role, and content array<PART> or text).

    The conversation is the concatenation of its segments by turn. Null text is
    empty, a null role too; null content is a turn without parts; parts of
    unknown types are attachments. Other columns are ignored. Offsets are in characters of the segment.
    """
    rich = "content" in messages.columns
    body = F.col("content") if rich else F.col("text").cast("string")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), body.alias("body"))
    keys = ("segment", "loss_start", "loss_end", "attachments", "n_tokens")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))
    types = dict(zip(keys, (pa.string(), pa.int64(), pa.int64(), kind, pa.int64()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", rows=500):
                bodies = part.column(3).to_pylist()
                made = [render(role, (x or []) if rich else [{"type": "text", "text": x}]) for role, x in zip(part.column(2).to_pylist(), bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array([m[k] for m in made], types[k]) for k in keys)], names=["conv_id", "turn", "role", *keys])

    return rows.mapInArrow(run, FORMATTED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """READ_BACK: what each formatted conversation says, parsed from its segments alone.

    Turns come by turn (null first), then role and segment, so repeated turns
    have a place each; rows of a null conv_id are one conversation. Without
    rows there is none. Conversations stream through their task turn by turn and
    only digests are held, so a very long one needs no memory, though its
    digest is made by one task.
    """
    rows = formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", F.size("attachments").cast("long").alias("n_attachments"), "n_tokens")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    names = [x.split()[0] for x in READ_BACK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state:
                done.append((state["id"], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["attached"], state["tokens"]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in n else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

        for batch in batches:
            for conv, segment, low, high, attached, tokens in (row for part in slices(batch, "segment") for row in zip(*(part.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7)), strict=True)):
                if state is None or state["id"] != conv:
                    close()
                    state = {"id": conv, "turns": 0, "all": sha256(), "loss_chars": 0, "loss": sha256(), "chars": 0, "attached": 0, "tokens": 0}
                role, parts = parse(segment)
                state["turns"] += 1
                state["chars"] += len(segment)
                state["attached"] += attached
                state["tokens"] += tokens
                state["all"].update(f"{role}\n{''.join(parts)}\n".encode())
                if low is not None:
                    text = unescape(segment[low:high])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
            yield flush()
        close()
        yield flush()

    return dealt.mapInArrow(run, READ_BACK)
