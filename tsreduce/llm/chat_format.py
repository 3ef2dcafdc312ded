"""Chat formatting: typed content parts are visited in order and flattened into text with placeholders."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A turn: START role \n content END \n. All control strings begin with <| and end with |>.
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PLACEHOLDER = re.compile(r"<\|(image|audio|document)\|>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = "formatted string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    """No <| is left: each < that backslashes (or none) and a | follow gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one turn; out is its content, in which placeholders stand where their parts stood."""

    patch: int = 28
    frames_per_second: float = 25.0
    tokens_per_page: int = 256
    out: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        visitor = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if visitor is None:
            raise ValueError(f"unknown part type {part.get('type')!r}")
        visitor(part)

    def put(self, content: str) -> None:
        self.out.append(content)
        self.length += len(content)

    def flush(self) -> None:
        """Texts that meet are escaped as one: a control string may begin in one and end in the next."""
        self.put(escape("".join(self.text)))
        self.text.clear()

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self.put(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, max(1, -(-(part.get("width") or 0) // self.patch)) * max(1, -(-(part.get("height") or 0) // self.patch)))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, int((part.get("seconds") or 0) * self.frames_per_second)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, (part.get("pages") or 0) * self.tokens_per_page))


def format_turn(role: str | None, parts: list[dict] | None, trained: tuple[str, ...]) -> dict:
    """One turn as text; loss_start and loss_end delimit what a model is trained on, attachments' at counts from its start."""
    role, flat = role or "", Flattener()
    for part in parts or ():
        if part is not None:
            flat.visit(part)
    flat.flush()
    content = "".join(flat.out)
    head = f"{START}{escape_role(role)}\n"
    loss = role in trained
    return {"formatted": f"{head}{content}{END}\n", "loss_start": len(head) if loss else None, "loss_end": len(head) + len(content) if loss else None, "attachments": [a | {"at": a["at"] + len(head)} for a in flat.attachments], "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}


def text_parts(text: Column) -> Column:
    """A text as a list of one part; null is an empty text."""
    return F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.coalesce(text, F.lit("")), *(x for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")) for x in (F.lit(name), F.lit(None).cast(kind)))))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, *, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """For every row of turns: conv_id, turn, role, the formatted segment, its loss span (null: not trained on), attachments and expanded_tokens.

    A conversation is its segments in order of turn (then role, then segment), one after another, with nothing between;
    each is formatted where its row lies, without a shuffle, so a conversation may hold any share of all rows. parts: an
    array of PART; by default the column text as a part. Null roles, texts and lists of parts are empty; a repeated row
    is a further turn; an unknown part type is an error. Inside texts and roles control strings are escaped reversibly.
    """
    parts = text_parts(F.col("text")) if parts is None else parts
    kinds = dict(turns.dtypes)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))

    def batches(it):
        for b in it:
            made = [format_turn(r, p, trained) for r, p in zip(b.column("role").to_pylist(), b.column("parts").to_pylist())]
            col = lambda name, t: pa.array([m[name] for m in made], t)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), col("formatted", pa.string()), col("loss_start", pa.int64()), col("loss_end", pa.int64()), col("attachments", kind), col("expanded_tokens", pa.int64())], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    return rows.mapInArrow(batches, f"conv_id {kinds[conv_col]}, turn {kinds[turn_col]}, role string, {SEGMENT}")


class _Reader:
    """Digests of one conversation, fed with its formatted text piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.tokens = 0

    def feed(self, segment: str, start: int | None, end: int | None) -> None:
        self.formatted_chars += len(segment)
        at = 0
        for m in TURN.finditer(segment):
            if m.start() != at:
                break
            at = m.end()
            self.n_turns += 1
            self.turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        if at != len(segment):
            raise ValueError(f"not a formatted turn: {json.dumps(segment[:80])}")
        if start is not None:
            text = unescape(PLACEHOLDER.sub("", segment[start:end]))
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the formatted segments alone.

    A digest runs over a conversation's text in order, so one task reads it; it holds one batch of rows at a time.
    """
    kind = dict(segments.dtypes)["conv_id"]
    rows = segments.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def batches(it):
        now, reader, done = None, None, []
        for b in it:
            ids = b.column("conv_id")
            for k, s, x, y in zip(ids.to_pylist(), b.column("formatted").to_pylist(), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist()):
                if reader is None or k != now:
                    if reader is not None:
                        done.append((now, *reader.row()))
                    now, reader = k, _Reader()
                reader.feed(s, x, y)
            if done:
                yield table(done, ids.type)
                done = []
            last = ids.type
        if reader is not None:
            yield table([(now, *reader.row())], last)

    def table(done, t):
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], t), *(pa.array(c, k) for c, k in zip(columns[1:], DIGESTS.values()))], ["conv_id", *DIGESTS])

    return rows.mapInArrow(batches, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
