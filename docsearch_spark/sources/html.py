"""HTML pages to plain text (A5), as native regex replacements and one batch function.

Own definition (the reference delegates to a web loader): drop script and
style blocks and comments, turn every remaining tag into a space, replace
character references (each once, so ``&amp;lt;`` gives ``&lt;``), then normalise
whitespace as for documents. Character references follow the HTML rules for
named, decimal and hexadecimal forms.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.functions.text import col_, normalize_ws, or_empty

DROP_BLOCKS = [r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>",
               r"(?s)<!--.*?-->"]
TAG = r"(?s)<[^>]*>"


def html_to_text(page) -> Column:
    t = or_empty(col_(page))
    for pat in DROP_BLOCKS:
        t = F.regexp_replace(t, pat, " ")
    t = F.regexp_replace(t, TAG, " ")
    # most texts hold no entity and stay in the JVM
    return normalize_ws(F.when(F.contains(t, F.lit("&")), unescape(t)).otherwise(t))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references (named, decimal, hexadecimal) to characters."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


# --------------------------------------------------------------------------
# the same text by a scan with states, for pages that no chain of patterns reads right

# Fixed values of HTML: elements whose content is not markup, and is or is not text.
RAW_TEXT = ("script", "style")
ESCAPABLE_TEXT = ("title", "textarea")

_TAG_NAME = re.compile(r"[^\s/>]+")
_BEFORE_ATTRIBUTE = re.compile(r"[\s/]*")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_LAST = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT + ESCAPABLE_TEXT}


def _after_tag(page: str, at: int) -> int:
    """The position behind a tag's ``>``, from behind its name; -1 if it never ends."""
    while True:
        at = _BEFORE_ATTRIBUTE.match(page, at).end()
        if at >= len(page):
            return -1
        if page[at] == ">":
            return at + 1
        at = _ATTRIBUTE_NAME.match(page, at).end()
        value = _EQUALS.match(page, at)
        if value:
            at = value.end()
            if page[at:at + 1] in ('"', "'"):
                at = page.find(page[at], at + 1) + 1
                if at == 0:
                    return -1
            else:
                at = _UNQUOTED.match(page, at).end()


def _after_comment(page: str, at: int) -> int:
    """The position behind a comment, from behind its ``<!--``; -1 if it never ends."""
    for short in (">", "->"):
        if page.startswith(short, at):
            return at + len(short)
    ends = [(end, mark) for mark in ("-->", "--!>") if (end := page.find(mark, at)) >= 0]
    return min(ends)[0] + len(min(ends)[1]) if ends else -1


def scan_text(page: str) -> str:
    """A page's text, each tag, comment and raw element a space; one pass over the page.

    States: text, tag (with attribute values in either quotes or none), comment, raw
    text. An unfinished tag or comment, and a raw element that is not closed, reach to
    the end. ``<`` that begins none of these is text.
    """
    out: list[str] = []
    at = 0
    while (lt := page.find("<", at)) >= 0:
        out.append(page[at:lt])
        begin = page[lt + 1:lt + 2]
        closing = begin == "/"
        name_at = lt + 1 + closing
        first = page[name_at:name_at + 1]
        if first.isascii() and first.isalpha():
            name = _TAG_NAME.match(page, name_at)
            at = _after_tag(page, name.end())
            element = name.group().lower()
            if at >= 0 and not closing and element in _LAST:
                last = _LAST[element].search(page, at)
                end = last.start() if last else len(page)
                out.append(" ")
                if element in ESCAPABLE_TEXT:
                    out.append(page[at:end])
                at = end
        elif page.startswith("<!--", lt):
            at = _after_comment(page, lt + 4)
        elif begin in ("!", "?") or closing and first:
            at = page.find(">", lt) + 1 or -1
        else:
            out.append("<")
            at = lt + 1
            continue
        out.append(" ")
        if at < 0:
            return "".join(out)
    out.append(page[at:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def _scanned(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: html.unescape(scan_text(p)) if p else "")


def html_text_by_states(page) -> Column:
    """A5 by ``scan_text``, white space normalised; a null page gives ''. Pages without
    markup and references stay in the JVM."""
    p = or_empty(col_(page))
    plain = ~(F.contains(p, F.lit("<")) | F.contains(p, F.lit("&")))
    return normalize_ws(F.when(plain, p).otherwise(_scanned(p)))
