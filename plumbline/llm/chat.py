"""Conversations as training text, for any template that is a function from turns to text.

The template is a black box: ``render(turns)`` takes a list of ``(role, text)`` and returns the formatted text. For each
conversation the prefixes of one, two, ... turns are rendered one after the other. Where an output begins with the one
before it, the new part is the span of the new turn; where it does not, the template has rewritten history at this turn,
which is reported. Inside a span the text itself is found by rendering the prefix once more with one strange character in
its place: what stands before and after that character is the frame that the template put around the text. A template
that changes the text in another way than its ``escape`` is reported as well. Spans of a conversation that was
rewritten or changed are not given, so that no loss is ever taken on the wrong characters.

``Tagged`` is a template whose control strings cannot occur in a text: a backslash is put after the first character of
each, and each that already has some gets one more, which ``unescape`` takes away again.

Rows are sorted by conversation and turn through one shuffle and worked on as a stream; a task holds one conversation and
two renderings of it. Prefix rendering is quadratic in the turns of one conversation by nature of the method.

Cases: a null text is empty, a null role is an empty role; rows with a null ``conv_id`` are one conversation; a null turn
comes first; equal turns are ordered by role and text, and repeated rows are turns of their own. An empty table gives an
empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

Turns = list[tuple[str, str]]
# Characters that a role may not show, so that it neither ends its own mark nor holds a control string.
_ROLE = str.maketrans({"\\": r"\b", "[": r"\l", "]": r"\r", "<": r"\s", ">": r"\g"})
_ROLE_BACK = {"b": "\\", "l": "[", "r": "]", "s": "<", "g": ">"}
STRANGE = [chr(0xE000 + n) for n in range(64)]
_SPAN = "struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>"
SCHEMA = f"conv_id long, formatted string, spans array<{_SPAN}>, rewritten array<int>, changed array<int>"


class Tagged:
    """``[INST] user [/INST]``, ``assistant</s>``, and ``[TURN:role]text[/TURN]`` for every other role."""

    control = re.compile(r"([\[<])(\\*)(/?INST\]|/s>|s>|TURN:|/TURN\])")
    escaped = re.compile(r"([\[<])\\(\\*)(/?INST\]|/s>|s>|TURN:|/TURN\])")

    def escape(self, text: str) -> str:
        return self.control.sub(r"\1\2\\\3", text) if "[" in text or "<" in text else text

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1\2\3", text) if "\\" in text else text

    def render(self, turns: Turns) -> str:
        return "".join([self._turn(role, self.escape(text)) for role, text in turns])

    @staticmethod
    def _turn(role: str, text: str) -> str:
        if role == "user":
            return f"[INST] {text} [/INST]"
        if role == "assistant":
            return f"<s>{text}</s>"
        return f"[TURN:{role.translate(_ROLE)}]{text}[/TURN]"

    def role_of(self, span: str) -> str:
        """The role that a turn's formatted text names."""
        if span.startswith("[INST] "):
            return "user"
        if span.startswith("<s>"):
            return "assistant"
        name = span[len("[TURN:") : span.index("]")]
        return re.sub(r"\\(.)", lambda m: _ROLE_BACK[m[1]], name)


class PrefixRenderer:
    """Spans of one conversation after another for one template."""

    def __init__(self, render: Callable[[Turns], str], escape: Callable[[str], str] = str):
        self.render, self.escape = render, escape

    def frame(self, before: Turns, role: str, at: int, text: str) -> tuple[str, str] | None:
        """What the template puts before and after the text of the turn that follows ``before``."""
        for strange in STRANGE:
            if strange in text or strange in role:
                continue
            head, found, tail = self.render([*before, (role, strange)])[at:].partition(strange)
            if found and strange not in tail:
                return head, tail
        return None

    def spans(self, turns: Turns, loss_roles: set[str]) -> tuple[str, list[dict], list[int], list[int]]:
        """Formatted text, spans in code points, and the turns at which history was rewritten or the text changed."""
        done, last, spans, rewritten, changed = [], "", [], [], []
        for n, (role, text) in enumerate(turns):
            whole = self.render([*done, (role, text)])
            if not whole.startswith(last):
                rewritten.append(n)
            elif not rewritten:
                framed = self.frame(done, role, len(last), text)
                head, tail = framed or ("", "")
                if framed is None or whole[len(last) :] != head + self.escape(text) + tail:
                    changed.append(n)
                spans.append({"role": role, "start": len(last), "end": len(whole), "text_start": len(last) + len(head),
                              "text_end": len(whole) - len(tail), "loss": role in loss_roles})
            done.append((role, text))
            last = whole
        return last, [] if rewritten or changed else spans, rewritten, changed


def formatted(turns: DataFrame, template=None, loss_roles: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, spans, rewritten, changed``, one row per conversation.

    ``spans`` holds per turn its role, the code points ``[start, end)`` of the turn and ``[text_start, text_end)`` of its text in
    ``formatted``, and whether the text is under the loss mask. ``rewritten`` and ``changed`` are numbers of turns, from
    0; where one of them is not empty, there are no spans. ``template`` has ``render`` and, if it escapes, ``escape``.
    """
    template = template or Tagged()
    renderer = PrefixRenderer(template.render, getattr(template, "escape", str))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.sorted_blocks(batches, ["none", "conv_id"]):
            starts = common.group_starts(table, ["none", "conv_id"])
            ids, none = table.column("conv_id").to_pylist(), table.column("none").to_pylist()
            for a, b in zip(starts[:-1], starts[1:]):
                part = table.slice(a, b - a)
                held = list(zip(part.column("role").to_pylist(), part.column("text").to_pylist()))
                row = {"conv_id": None if none[a] else ids[a]}
                row["formatted"], row["spans"], row["rewritten"], row["changed"] = renderer.spans(held, set(loss_roles))
                yield pa.RecordBatch.from_pylist([row], _ARROW)

    rows = turns.select(
        F.col(conv_id).isNull().alias("none"), F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("none", "conv_id").sortWithinPartitions("none", "conv_id", "turn", "role", "text")
    return rows.select("none", "conv_id", "role", "text").mapInArrow(render, SCHEMA)


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()),
    ("spans", pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")], ("loss", pa.bool_())]))),
    ("rewritten", pa.list_(pa.int32())), ("changed", pa.list_(pa.int32()))])


def read_back(done: DataFrame, template: Tagged | None = None) -> DataFrame:
    """``conv_id, turns, loss_text, loss_chars, formatted_chars``: roles and texts as the formatted text holds them, and what the loss is taken on.

    Only ``formatted`` and the offsets of ``spans`` are read; roles come from the formatted text.
    """
    template = template or Tagged()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                whole = row["formatted"]
                texts = [template.unescape(whole[s["text_start"] : s["text_end"]]) for s in row["spans"]]
                roles = [template.role_of(whole[s["start"] : s["end"]]) for s in row["spans"]]
                out.append({"conv_id": row["conv_id"], "turns": [{"role": r, "text": t} for r, t in zip(roles, texts)],
                            "loss_text": "".join(t for s, t in zip(row["spans"], texts) if s["loss"]), "formatted_chars": len(whole)})
            yield pa.RecordBatch.from_pylist(out, _READ)

    back = done.select("conv_id", "formatted", "spans").mapInArrow(read, _READ_SCHEMA)
    return back.withColumn("loss_chars", F.length("loss_text").cast("long"))


_READ = pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                   ("loss_text", pa.string()), ("formatted_chars", pa.int64())])
_READ_SCHEMA = "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"

# A conversation whose texts look like the template's own marks.
OWN_ID, OWN_TEXT = -7, "</s>[INST] ok [/INST]"


def op12_chat(spark, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    rows = common.table(spark, sf_dir, "conversations").select(names)
    own = spark.createDataFrame([(OWN_ID, 0, "user", OWN_TEXT), (OWN_ID, 1, "assistant", OWN_TEXT)], "conv_id long, turn long, role string, text string")
    back = read_back(formatted(rows.unionByName(own)))
    told = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        "loss_chars", F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {OWN_ID}, 0, 'user', '{OWN_TEXT}' UNION ALL SELECT {OWN_ID}, 1, 'assistant', '{OWN_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '[\\[<]\\\\*(/?INST\\]|/s>|s>|TURN:|/TURN\\])'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
      ELSE 14 + length(role) + len(regexp_extract_all(role, '[\\[\\]<>\\\\]')) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""

QUERIES = {"op12_chat": (op12_chat, OP12_SQL)}
