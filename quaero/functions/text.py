"""Column functions over text: search tokens, matching keys, blanks and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# One CJK character, a run of Latin letters, or a decimal number is a token;
# the 29 code points that count as white space.
TOKEN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|[A-Za-z]+|\p{Nd}+(?:\.\p{Nd}+)?"
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_TOKEN = re.compile(TOKEN.replace(r"\p{Nd}", r"\d").replace(r"\x{", r"\u").replace("}", "")).findall
_NUMBER = re.compile(rb"[0-9]+(?:\.[0-9]+)?").findall
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 else 32 for b in range(256))
_DIGITS = bytes(b if b in b"0123456789." else 32 for b in range(256))
#: Bytes of which no CJK character and no number but 0-9 has its first byte: below U+0280, and U+2000 to U+2FFF.
_PLAIN = bytes(b for b in range(256) if b < 0xCA or b == 0xE2)


def token_bag(text: bytes) -> list[bytes]:
    """The tokens of :func:`tokens`, of one UTF-8 text in a Python worker, in no order."""
    low = text.lower()  # of bytes only A-Z have a lower case
    if low.translate(None, _PLAIN):
        return [t.encode() for t in _TOKEN(low.decode("utf-8", "replace"))]
    found = low.translate(_LETTERS).split()
    for piece in low.translate(_DIGITS).split():
        if piece != b".":
            found += _NUMBER(piece)
    return found


def tokens(text: Column) -> Column:
    """Search tokens of a text, lower-case, in order; none for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def search_text(name: Column, text: Column) -> Column:
    """What is indexed of a row: its name, a space, its text."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def match_key(text: Column) -> Column:
    """A text for equality matching: line ends and runs of white space are one space, trimmed; characters stay as they are."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " ")
    return F.regexp_replace(spaced, "^ | $", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or white space only."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "") == ""


def safe_name(name: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot, dash and underscore become an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def error_class(kind: Column, message: Column) -> Column:
    """The class of a failed run: out of memory, a missing quantization library, or the exception's own name."""
    low = F.lower(F.coalesce(message, F.lit("")))
    memory = low.contains("out of memory") | (low.contains("cuda") & low.contains("memory"))
    return F.when(memory, "cuda_oom").when(low.contains("bitsandbytes"), "missing_bitsandbytes").otherwise(kind)
