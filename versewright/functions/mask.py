"""Citation masks.  A mask is a literal, so it becomes one Column once; rendering is then a bulk projection."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a mask writes by name.
CHARACTERS = {"nbsp": " ", "newline": "\n", "tab": "\t"}
CONTENT_KEYS = ("content", "content_numbered")


def needs_content(mask: str) -> bool:
    """Whether a mask shows verse text; without it the verses are not joined at all."""
    return any(f"[{key}]" in mask for key in CONTENT_KEYS)


def values_of(rng: Column, texts: dict[str, Column]) -> dict[str, Column]:
    """The variables of a mask by key.  End values that repeat the begin are empty."""
    begin, end = rng["from"], rng["to"]
    other_book = begin["book_ord"] != end["book_ord"]
    other_chapter = other_book | (begin["chapter"] != end["chapter"])
    text = lambda key: F.coalesce(texts[key], F.lit("")) if key in texts else F.lit("")
    shown = lambda cond, value: F.when(cond, value.cast("string")).otherwise("")
    plain = ("content", "content_numbered", "book", "book_long", "book_abbr", "scripture", "scripture_abbr", "copyright")
    return {key: text(key) for key in plain} | {
        "book_end": shown(other_book, text("book_end")),
        "#chapter_begin": begin["chapter"].cast("string"),
        "#verse_begin": begin["verse"].cast("string"),
        "#chapter_end": shown(other_chapter, end["chapter"]),
        "#verse_end": shown(begin != end, end["verse"]),
    }


@dataclass
class _Group:
    """Rendered pieces of a mask and the variables among them, those of dropped groups included."""

    pieces: list[Column]
    variables: list[Column]

    def text(self) -> Column:
        return F.concat(*self.pieces) if self.pieces else F.lit("")

    def filled(self) -> Column:
        return F.concat(*self.variables) != ""


def _group_end(mask: str, begin: int) -> int | None:
    depth = 0
    for brace in re.finditer(r"[{}]", mask[begin:]):
        depth += 1 if brace.group() == "{" else -1
        if depth == 0:
            return begin + brace.start()
    return None


def _compile(mask: str, values: dict[str, Column]) -> _Group:
    out, literal, at = _Group([], []), "", 0
    while at < len(mask):
        end = None
        if mask[at] == "{" and (end := _group_end(mask, at)) is not None:
            inner = _compile(mask[at + 1:end], values)
            if inner.variables:
                out.pieces += [F.lit(literal), F.when(inner.filled(), inner.text()).otherwise("")]
                literal = ""
            else:
                out.pieces += [F.lit(literal + "{"), inner.text()]
                literal = "}"
            out.variables += inner.variables
        elif mask[at] == "[" and (close := mask.find("]", at)) >= 0:
            key = mask[at + 1:close]
            if key in values:
                out.pieces += [F.lit(literal), values[key]]
                out.variables.append(values[key])
                literal, end = "", close
            elif key in CHARACTERS:
                literal, end = literal + CHARACTERS[key], close
        if end is None:
            literal += mask[at]
            end = at
        at = end + 1
    out.pieces.append(F.lit(literal))
    return out


def render(mask: str, values: dict[str, Column]) -> Column:
    """The mask with its variables replaced; a group ``{}`` whose variables are all empty drops out."""
    return _compile(mask, values).text()
