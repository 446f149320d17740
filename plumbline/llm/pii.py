"""Personal data, also in disguise: offset-preserving deobfuscation.

Plain patterns find e-mail addresses, IP addresses, card and phone numbers. Three transducers then rewrite a text while
they keep, per character written, the source characters it stands for: look-alike letters and digits of other scripts
become ASCII and invisible characters vanish; at/dot disguises (``[at]``, ``(dot)``, ``name at host dot org``, in any
mix) become ``@`` and ``.``, ``192 dot 168 dot 0 dot 1`` as well; spelled digits, and the letters O, I and l inside a number, become
digits. The same patterns run on the rewritten text, and what they find
is mapped back to source offsets. A span found this way is added if rewriting touched it and no plain span of its kind
covers it wholly: one that reaches beyond a plain span is added beside it. Spans of the plain patterns always stay.

Outside: an address with blanks at a plain ``@`` (``jane @example.com``) is left alone, as people are named that way.

Patterns start only where a match can start, so texts of any length cost time in proportion to their length.

Cases: a null or empty text has no span. Repeated rows give equal rows; a null id stays null. An empty table gives no
rows. Further columns are ignored, or pass through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
LOOK_ALIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Х": "X", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Digits as words.
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
INVISIBLE = "­​‌‍⁠﻿"

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_FOREIGN = re.compile(
    "[" + INVISIBLE + "".join(LOOK_ALIKE) + "٠-٩۰-۹०-९․⁰-₉①-⑨！-～\U0001d400-\U0001d7ff]"
)
_WORD = "|".join(SPELLED)
_DIGIT_RUN = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[ -]+)?(?:{_WORD}|[0-9]+)(?:(?:[ ,-]+|[ ]+(?:dot|point)[ ]+|\.)(?:{_WORD}|[0-9]+))+(?![A-Za-z0-9])", re.I)
_TWO_SPELLED = re.compile(rf"(?:{_WORD})[ ,.-]+(?:dot +|point +)?(?:{_WORD}|[0-9])", re.I)
_DIGIT_PART = re.compile(rf"plus|dot|point|{_WORD}|[0-9]+|[ ,.-]+", re.I)
_BRACKET = re.compile(r"[\[({<]\s*+(at|@|dot|\.|punkt|punto|point)\s*+[\])}>]\s*+", re.I)
# Letters that stand for digits inside a number, and addresses whose dots are spoken.
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[OoIl]*+[0-9])(?=[0-9]++[OoIl]|[OoIl])[0-9OoIl]++(?![A-Za-z0-9])")
_AS_DIGIT = str.maketrans("OoIl", "0011")
_SAID_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:(?:\.| ++dot ++)[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])", re.I)
_AT = re.compile(r"@|(?<=\s)at(?=\s)", re.I)
_LABELS = r"[A-Za-z0-9-]+(?:(?:\.|\s+dot\s+)[A-Za-z0-9-]+)*"
_HOST_AT = re.compile(rf"\s*({_LABELS}(?:\.|\s+dot\s+)[A-Za-z0-9-]+)", re.I)
_HOST_SIGN = re.compile(rf"({_LABELS}(?:\.[A-Za-z0-9-]+|\s+dot\s+[A-Za-z]{{2}}[A-Za-z0-9-]*))", re.I)
_SAID_DOT = re.compile(r"\s+dot\s+", re.I)
_TOP = re.compile(r"\.[A-Za-z]{2}[A-Za-z0-9-]*\Z")
_HINT = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|punkt|punto|point)\s*[\])}>]|\sdot\s", re.I)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each ``@``, the whole run of local characters before it that is not yet taken."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1) if at > done else None
        if host:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the plain patterns, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


class Tape:
    """A text with, per character, the source characters it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ``[a, b)`` by a string, for sorted edits that do not overlap. Each written character stands for all that it replaces."""
        if not edits:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for a, b, out in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            if out:
                text.append(out)
                start += [self.start[a]] * len(out)
                end += [self.end[b - 1]] * len(out)
                new += b"\1" * len(out)
            elif a < b and new:
                new[-1] = 1
            at = b
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


def _look_alike(c: str) -> str:
    if c in INVISIBLE:
        return ""
    out = LOOK_ALIKE.get(c) or unicodedata.normalize("NFKC", c)
    if len(out) == 1 and out.isascii():
        return out
    digit = unicodedata.digit(c, None)
    return c if digit is None else str(digit)


def undisguise(text: str) -> Tape | None:
    """The text after the three transducers, or None if there is nothing to rewrite."""
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), out) for m in _FOREIGN.finditer(text) if (out := _look_alike(m[0])) != m[0]])
    tape.rewrite([(m.start() + n, m.start() + n + 1, c.translate(_AS_DIGIT)) for m in _LETTER_DIGITS.finditer(tape.text) for n, c in enumerate(m[0]) if c in "OoIl"])
    hint = _HINT.search(tape.text)
    if hint:
        tape.rewrite(_bracket_edits(tape.text))
        tape.rewrite([(d.start(), d.end(), ".") for m in _SAID_IP.finditer(tape.text) for d in _SAID_DOT.finditer(tape.text, m.start(), m.end())])
    if hint or 1 in tape.new:
        tape.rewrite(_said_edits(tape))
    if _TWO_SPELLED.search(tape.text):
        edits = []
        for run in _DIGIT_RUN.finditer(tape.text):
            if _TWO_SPELLED.search(run[0]):
                edits += _digit_edits(tape.text, run.start(), run.end())
        tape.rewrite(edits)
    return tape if any(tape.new) else None


def _blanks(text: str, low: int, end: int) -> int:
    """Where the white space that ends at ``end`` starts, not before ``low``."""
    while end > low and text[end - 1].isspace():
        end -= 1
    return end


def _bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Bracketed signs with the white space around them; a run of it is looked at once from each side."""
    edits, done = [], 0
    for m in _BRACKET.finditer(text):
        edits.append((_blanks(text, done, m.start()), m.end(), "@" if m[1].lower() in ("at", "@") else "."))
        done = m.end()
    return edits


def _local_part(text: str, low: int, end: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Start of the local part that ends at ``end``, not before ``low``, and the edits for its spoken dots."""
    edits, start = [], end
    while True:
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        said = _blanks(text, low, start)
        if said == start or text[max(low, said - 3) : said].lower() != "dot":
            return start, edits[::-1]
        name = _blanks(text, low, said - 3)
        if not low < name < said - 3 or text[name - 1] not in _LOCAL or "." in (text[name - 1], text[start]):
            return start, edits[::-1]
        edits.append((name, start, "."))
        start = name


def _said_edits(tape: Tape) -> list[tuple[int, int, str]]:
    """Spoken ``at`` and ``dot`` of addresses. A dot is spoken next to any ``@``. ``at`` is spoken only where a dot of the address is spoken or was
    rewritten: "name at host.org" is plain speech."""
    text, edits, done = tape.text, [], 0
    for at in _AT.finditer(text):
        if at.start() < done:
            continue
        sign = at[0] == "@"
        host = (_HOST_SIGN if sign else _HOST_AT).match(text, at.end())
        end = at.start() if sign else _blanks(text, done, at.start())
        if not host or end <= done or text[end - 1] not in _LOCAL or not sign and text[end - 1] == ".":
            continue
        start, dots = _local_part(text, done, end)
        said = [(m.start(), m.end(), ".") for m in _SAID_DOT.finditer(text, host.start(1), host.end())]
        if not sign:
            was = any(tape.new[n] and text[n] == "." for part in ((start, end), host.span(1)) for n in range(*part))
            if start and text[start - 1].isalnum() or not (said or (dots or was) and _TOP.search(host[1])):
                continue
            dots.append((end, host.start(1), "@"))
        edits += dots + said
        done = host.end()
    return edits


def _digit_edits(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Spelled digits become digits, blanks between two of them vanish, ``dot`` and ``plus`` become their signs."""
    parts = [(m.start(), m.end(), m[0].lower()) for m in _DIGIT_PART.finditer(text, start, end)]
    edits = []
    for n, (a, b, word) in enumerate(parts):
        before, after = (parts[n - 1][2] if n else ""), (parts[n + 1][2] if n + 1 < len(parts) else "")
        if word in SPELLED:
            edits.append((a, b, SPELLED[word]))
        elif word in ("dot", "point"):
            edits.append((a, b, "."))
        elif word == "plus":
            edits.append((a, b, "+"))
        elif not word.isdigit() and "." not in word:
            if before in SPELLED and after in SPELLED or {before, after} & {"dot", "point", "plus"}:
                edits.append((a, b, ""))
            elif "," in word or len(word) > 1:
                edits.append((a, b, " "))
    return edits


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and the further ones that deobfuscation finds; ``(start, kind number, end)`` in source code points."""
    base = plain_spans(text)
    tape = undisguise(text)
    added = []
    if tape:
        for a, kind, b in plain_spans(tape.text):
            start, end = tape.start[a], tape.end[b - 1]
            if any(tape.new[a:b]) and not any(k == kind and s <= start and end <= e for s, k, e in base):
                added.append((start, kind, end))
    return base, sorted(set(added))


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts of plain spans per kind, ``n_added``, ``base_sha256`` and ``spans``: one row per input row."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id long, {counts}, n_added long, base_sha256 string, spans string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, added = spans(body or "")
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(told(base).encode()).hexdigest()
                rows.append((owner, *(kinds.count(k) for k in range(4)), len(added), digest, told(base + added)))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            names = [x.split()[0] for x in schema.split(", ")]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(read, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are replaced together."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for body in texts:
            base, added = spans(body or "")
            done, at = [], 0
            for a, kind, b in sorted(base + added):
                if a >= at:
                    done += [body[at:a], f"<{KINDS[kind].upper()}>"]
                at = max(at, b)
            out.append(body if not done else "".join([*done, body[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text)))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": (op6_pii, None)}
