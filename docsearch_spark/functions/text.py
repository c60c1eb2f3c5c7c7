"""Column expressions for text preparation (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.split()/str.strip() treat as whitespace.
# Java's \s only covers [ \t\n\x0B\f\r]; the file/group separators, NEL and the
# Unicode space separators (Zs, Zl, Zp) are added explicitly.
WS_CLASS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WS_RUN = WS_CLASS + "+"
# Runs that are not one plain space already. Most characters fail the look-ahead, one
# comparison, and words with one space between them are left as they are.
WS_UNLIKE_SPACE = r"(?=[^!-~])(?:[\s\x0B\x1C-\x1F\x85\p{Z}&&[^ ]]| " + WS_CLASS + ")" + WS_CLASS + "*"
EDGE_WS = "^" + WS_RUN + "|" + WS_RUN + "$"

# Tokens of the default hashed embedder: maximal runs of letters and digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Citation markers in generated answers: [S<digits>].
CITATION_PATTERN = r"\[S(\d+)\]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(text) -> Column:
    """``" ".join(text.split())``: every whitespace run becomes one space, ends trimmed.

    After the replacement the only whitespace left is U+0020, so Spark's
    ``trim`` (which strips U+0020 only) equals Python's ``strip`` here.
    """
    return F.trim(F.regexp_replace(col_(text), WS_UNLIKE_SPACE, " "))


def py_strip(text) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_(text), EDGE_WS, "")


def or_empty(text) -> Column:
    """``value or ""``."""
    return F.coalesce(col_(text), F.lit(""))


def is_blank(text) -> Column:
    """True when the text is null or only whitespace."""
    return F.length(py_strip(or_empty(text))) == 0


def tokens(text) -> Column:
    """Lower-cased letter/digit tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(TOKEN_PATTERN), 0)


def hash_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token: first 32 bits of md5 as an unsigned integer, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"),
                  F.lit(dim)).cast("int")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it for ``body`` (a lambda).

    Referencing a Python-level Column twice inlines its whole expression twice
    (inside a higher-order function: once per element). Binding it as the
    lambda variable of a one-element ``transform`` evaluates it once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def uuid_from(*parts) -> Column:
    """Deterministic UUID-shaped text from md5 of the joined parts.

    Random UUIDs would change on a task retry; these do not.
    """
    return let(F.md5(F.concat_ws("#", *[col_(p).cast("string") for p in parts])),
               lambda h: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                                     F.substring(h, 13, 4), F.substring(h, 17, 4),
                                     F.substring(h, 21, 12)))


def file_suffix(path) -> Column:
    """Lower-cased suffix of the last path component, with the dot ('' if none)."""
    name = F.regexp_extract(col_(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))


def file_stem(path) -> Column:
    """Last path component without its final suffix."""
    name = F.regexp_extract(col_(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
