"""Text rules: stripping, canonical labels, number and date shapes, noise and redaction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shapes of numbers and dates held as text.
NUMBER_SHAPE = r"^-?\d{1,3}(,\d{3})*(\.\d+)?$|^-?\d*\.?\d+$"
DATE_SHAPE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
# Words that make a text column boolean.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n", "0", "1", "t", "f"]

BLANKS = " \t\n\r\f\x0b"
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
FLOAT_SHAPE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|Inf|Infinity)$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonical(c: Column) -> Column:
    """Label key that ignores case and spacing."""
    return F.lower(squeeze(c))


def looks_numeric(c: Column) -> Column:
    return strip(c).rlike(NUMBER_SHAPE)


def looks_dated(c: Column) -> Column:
    return c.rlike(DATE_SHAPE)


def is_boolean_word(c: Column) -> Column:
    return F.lower(strip(c)).isin(BOOLEAN_WORDS)


def parse_number(c: Column) -> Column:
    """Text to double after dropping commas; anything else becomes NULL."""
    bare = strip(F.replace(c, F.lit(","), F.lit("")))
    return F.when(bare.rlike(FLOAT_SHAPE), bare.try_cast("double"))


def parse_time(c: Column) -> Column:
    """Text to timestamp: ISO first, then month/day/year with four or two digits."""
    bare = strip(c)
    iso = F.when(bare.rlike(ISO_SHAPE), bare.try_cast("timestamp"))
    return F.coalesce(
        iso,
        F.when(bare.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(bare, F.lit("M/d/yyyy"))),
        F.when(bare.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(bare, F.lit("M/d/yy"))),
    )


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    total = F.length(c).cast("double")
    letters = F.array_distinct(F.split(c, ""))
    share = lambda ch: F.length(c) - F.length(F.replace(c, ch, F.lit("")))
    part = lambda ch: share(ch) / total * F.log2(share(ch) / total)
    parts = F.transform(F.filter(letters, lambda ch: ch != ""), part)
    return F.when(total > 0, -F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)).otherwise(0.0)


def is_noise(c: Column, expects_identifier: bool = False) -> Column:
    """True for text without meaning: no letters or digits, one repeated
    character, keyboard smash, or an opaque token."""
    printable = F.trim(F.regexp_replace(c, r"\p{Cntrl}", ""))
    compact = F.regexp_replace(printable, r"\s+", "")
    low = F.lower(compact)
    n = F.length(compact)
    distinct = F.size(F.array_distinct(F.filter(F.split(low, ""), lambda ch: ch != "")))
    empty = ~printable.rlike(r"[\p{L}\p{N}]")
    repeated = (n >= 8) & (distinct <= 2)
    if expects_identifier:
        return empty | repeated
    vowels = F.length(F.regexp_replace(low, "[^aeiouy]", ""))
    smash = (
        (n >= 16)
        & compact.rlike("^[A-Za-z]+$")
        & ((vowels.cast("double") / F.greatest(n, F.lit(1)) < 0.28) | low.rlike("[^aeiouy]{6,}"))
    )
    classes = sum((compact.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", r"\d", "[_+./=-]")), F.lit(0))
    words = F.size(F.regexp_extract_all(printable, F.lit("[A-Za-z]{2,}"), F.lit(0)))
    spoken = printable.rlike(r"\s") & (words >= 2)
    token = compact.rlike("^[A-Za-z0-9_+./=-]{24,}$") & ~spoken & (classes >= 2)
    # The entropy is only worked out for the few values that already look like tokens.
    opaque = F.when(token, entropy(compact) >= 3.5).otherwise(F.lit(False))
    return empty | repeated | smash | opaque


# Own patterns for credential-like text; each whole match is replaced.
SECRET_SHAPES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "connection_url": r"\b[a-z][a-z0-9+]{2,20}://[^\s:/@]+:[^\s@/]+@[^\s]+",
    "bearer": r"\b[Bb]earer\s+[A-Za-z0-9._~+/-]{16,}=*",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "aws_key": r"\b(AKIA|ASIA)[A-Z0-9]{16}\b",
    "prefixed_key": r"\b(sk|pk|rk|ghp|gho|ghs|xoxb|xoxp|glpat)[-_][A-Za-z0-9_-]{16,}",
    "assignment": r"(?i)\b(password|passwd|pwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token)\b\s*[:=]\s*[^\s,;]{6,}",
}


def redact(c: Column, mark: str = "[REDACTED]") -> Column:
    for shape in SECRET_SHAPES.values():
        c = F.regexp_replace(c, shape, mark)
    return c


def has_secret(c: Column) -> Column:
    return c.rlike("|".join(f"({shape})" for shape in SECRET_SHAPES.values() if not shape.startswith("(?i)")) ) | c.rlike(
        SECRET_SHAPES["assignment"]
    )


def normalised_sql(c: Column) -> Column:
    """Query text with case and white space ignored."""
    return F.lower(squeeze(c))
