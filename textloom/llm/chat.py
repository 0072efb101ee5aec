r"""Chat formatting of typed content parts, with a reversible template.

A conversation becomes <|turn|>role<|text|>content<|end|> for each turn. A visitor walks a turn's parts in order:
text is escaped, an image, audio or document part becomes a placeholder <|image:0|> numbered through the conversation,
and its reference and expanded token count are recorded. A part of any other type becomes <|unknown:0|>, with its
reference and no tokens. Escaping puts a backslash before every backslash and inside
every control string, so that no control string, of this template or of other common ones, is left in content.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Openings of control strings of chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_CONTROL = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
_PLACE = re.compile(r"<\|(?:image|audio|document|unknown):\d+\|>")
_MOST = (1 << 63) - 1
FORMATTED = "formatted string, n_turns long, loss array<struct<start: int, end: int>>, attachments array<struct<at: int, kind: string, ref: string, tokens: long>>, attachment_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Flattens parts; keeps the attachments of one conversation."""

    def __init__(self, tile: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024):
        self.tile, self.audio_rate, self.page_tokens, self.attachments = tile, audio_rate, page_tokens, []

    def visit(self, part: dict, at: int) -> str:
        kinds = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        return kinds.get(part.get("type") or "text", self.visit_other)(part, at)

    def visit_text(self, part, at):
        return escape(part.get("text") or "")

    def visit_image(self, part, at):
        tiles = [-(-max(part.get(side) or 1, 0) // self.tile) for side in ("width", "height")]
        return self._place("image", part, at, tiles[0] * tiles[1])

    def visit_audio(self, part, at):
        seconds = part.get("seconds") or 0.0
        known = math.isfinite(seconds) and seconds > 0
        return self._place("audio", part, at, min(math.ceil(seconds * self.audio_rate), _MOST) if known and math.isfinite(seconds * self.audio_rate) else 0)

    def visit_document(self, part, at):
        pages = part.get("pages")
        return self._place("document", part, at, (1 if pages is None else max(pages, 0)) * self.page_tokens)

    def visit_other(self, part, at):
        return self._place("unknown", part, at, 0)

    def _place(self, kind, part, at, tokens):
        mark = f"<|{kind}:{len(self.attachments)}|>"
        self.attachments.append({"at": at, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return mark


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: id, formatted, n_turns, loss (spans of the content of `learnt` roles),
    attachments (place of the placeholder, kind, reference, tokens) and attachment_tokens.

    Turns go by number, equal numbers by role and parts; repeated rows are turns of their own; a null number comes
    first. A null role is empty, null parts and null text are empty content. A null id is a conversation like any
    other. The rows of a conversation arrive in order and only its output is held. An empty table gives no rows, and
    other columns of turns, whatever their names, are ignored.

    Image sizes and page counts that are null count as one tile or page, negative ones as none; seconds that are null,
    negative or not finite are no tokens; a conversation's sum stops at the greatest long.
    """
    ready(turns.sparkSession)
    kind = turns.schema[id_col].dataType.simpleString()

    def build(batches):
        own, state = object(), None
        done: list[tuple] = []

        def close():
            body, size, count, loss, visitor = state
            done.append((own, "".join(body), count, loss, visitor.attachments, min(sum(a["tokens"] for a in visitor.attachments), _MOST)))

        def frame():
            cols = list(zip(*done, strict=True))
            types = [out_type.field(i).type for i in range(len(out_type))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=out_type.names)

        for batch in batches:
            out_type = pa.schema([("id", batch.schema.field(0).type), ("formatted", pa.string()), ("n_turns", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("attachment_tokens", pa.int64())])
            for i, name, content in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if state is None or i != own:
                    if state is not None:
                        close()
                    own, state = i, [[], 0, 0, [], Visitor()]
                body, size, count, loss, visitor = state
                head = TURN + escape(name or "") + TEXT
                at = size + len(head)
                flat = ""
                for part in content or ():
                    flat += visitor.visit(part or {}, at + len(flat))
                body += [head, flat, END]
                if name in learnt:
                    loss.append({"start": at, "end": at + len(flat)})
                state[1], state[2] = at + len(flat) + len(END), count + 1
            if done:
                yield frame()
                done = []
        if state is not None:
            close()
            yield frame()

    rows = turns.select(F.col(id_col).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).cast(PARTS).alias("parts"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "parts").select("id", "role", "parts")
    return rows.mapInArrow(build, f"id {kind}, {FORMATTED}").withColumnRenamed("id", id_col)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, without its placeholders."""
    return [(unescape(r), unescape(_PLACE.sub("", t))) for r, t in _PIECE.findall(formatted)]


def digests(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text says: turns and text under the loss spans, hashed, and lengths in code points.

    One row for each row of conversations, null ids and repeats included; an empty table gives none. Only id_col,
    `formatted` and `loss` are read, which format_conversations never leaves null.
    """
    kind = conversations.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(body)
                loss = "".join(unescape(_PLACE.sub("", body[s["start"] : s["end"]])) for s in spans)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(body)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[j] for x in out], t) for j, t in enumerate(types))], names=names)

    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out = conversations.select(id_col, "formatted", "loss").mapInArrow(read, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)
