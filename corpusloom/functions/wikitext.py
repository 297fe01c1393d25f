"""Plain text of encyclopaedia dumps: nested templates, tables and links by balanced brackets.

Nesting can't be matched by one expression, so brackets are paired by a stack in one pass over a text,
linear in its length and without a bound on depth. Brackets that find no partner stay as they are. A null
text stays null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexmap import fold


def paired(text: str, opening: str, closing: str) -> list[tuple[int, int, int]]:
    """(start, end, depth from 1) of every balanced pair, in order of their ends."""
    found, open_ = [], []
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m[0] == opening:
            open_.append(m.start())
        elif open_:
            found.append((open_.pop(), m.end()))
    # depth counts pairs around a pair, not brackets that never close
    out, around = [], []
    for start, end in sorted(found):
        while around and around[-1] <= start:
            around.pop()
        around.append(end)
        out.append((start, end, len(around)))
    return sorted(out, key=lambda p: p[1])


def outermost(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    return sorted((a, b) for a, b, depth in paired(text, opening, closing) if depth == 1)


def without(text: str, opening: str, closing: str, instead: Callable[[str], str] = lambda inner: "") -> str:
    """The text with every outermost pair replaced by what its inside gives."""
    out, done = [], 0
    for a, b in outermost(text, opening, closing):
        out += [text[done:a], instead(text[a + len(opening) : b - len(closing)])]
        done = b
    return "".join([*out, text[done:]])


def _link(media: tuple[str, ...]):
    def shown(inner: str) -> str:
        """What a link shows: its last part, its links' parts in their turn; a picture shows nothing."""
        if inner.partition(":")[0].strip().lower() in media and ":" in inner:
            return ""
        return without(inner, "[[", "]]", shown).rpartition("|")[2]

    return shown


def clean(text: str, media: tuple[str, ...] = ("file", "image", "файл", "изображение")) -> str:
    """Templates, tables, comments, notes and tags go, links show what they show, quotes of bold and
    slanted text go."""
    text = re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL)
    text = without(without(text, "{{", "}}"), "{|", "|}")
    text = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", text, flags=re.DOTALL | re.IGNORECASE)
    text = without(text, "[[", "]]", _link(media))
    text = re.sub(r"\[(?:https?:|//)\S*\s*([^\]]*)\]", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^<>]*>", "", text)
    return re.sub(r"'{2,3}", "", text)


def cleaned(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean(t) if t is not None else None)

    return run(text)


def without_templates(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without(t, "{{", "}}") if t is not None else None)

    return run(text)


def prose_lines(text: Column, least: int = 40) -> Column:
    """Lines of running text: not short, no list, heading or table."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    return F.filter(lines, lambda s: (F.length(s) >= least) & ~s.rlike(r"^[*#;:=|{!]"))


def headings(text: Column) -> Column:
    """A heading's signs go."""
    return fold(text, (r"(?m)^[ \t]*(={2,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", "$2"))
