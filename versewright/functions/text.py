"""Text columns: character classes, trimming, passage markup and the patterns of book names and passages."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

WS = fixed.class_of(fixed.WHITESPACE_CODES)
LINE = fixed.class_of(fixed.LINE_CODES)
DROPPED = WS + LINE + "."
# The same classes as ranges, for long patterns.
_WS = fixed.ranges_of(fixed.WHITESPACE_CODES)
_LINE = fixed.ranges_of(fixed.LINE_CODES)
_DROPPED = fixed.ranges_of([*fixed.WHITESPACE_CODES, *fixed.LINE_CODES, ord(".")])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def category_counts(text: Column, lang: str) -> Column:
    """How many characters of a text are of each category: ``STRUCT<letter, whitespace, line, fullstop, digit, other>``.

    Letters are most of a text, so they are taken out once and the other categories counted in what is left.
    """
    letters = fixed.LETTERS[lang]
    without = lambda t, chars: F.char_length(F.regexp_replace(t, f"[{chars}]+", ""))

    def counted(rest):
        size = F.char_length(rest)
        return F.struct(
            (F.char_length(text) - size).alias("letter"), (size - without(rest, WS)).alias("whitespace"),
            (size - without(rest, LINE)).alias("line"), (size - without(rest, ".")).alias("fullstop"),
            (size - without(rest, "0-9")).alias("digit"), without(rest, f"0-9.{WS}{LINE}").alias("other"),
        )

    return let(F.regexp_replace(text, f"[{letters}]+", ""), counted)


def normalized(text: Column, lang: str) -> Column:
    """The text book names are searched in: white space, lines and full stops dropped, other characters as ``*``.

    One translation drops the characters and stars those of ASCII, which are nearly all; a pattern, which takes far longer
    a match, is left with the others, and texts of ASCII alone don't meet it.
    """
    dropped = "".join(map(chr, sorted({*fixed.WHITESPACE_CODES, *fixed.LINE_CODES, ord(".")})))
    starred = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "*" and c not in dropped)
    translated = F.translate(text, starred + dropped, "*" * len(starred))
    others = lambda t: F.regexp_replace(t, f"[^{fixed.LETTERS[lang]}0-9*]", "*")
    return let(translated, lambda t: F.when(t.rlike("[^\\x00-\\x7F]"), others(t)).otherwise(t))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def blank_outside(text: Column, begin: Column, end: Column) -> Column:
    """The text of ``[begin, end)`` at its place, spaces everywhere else."""
    n = F.char_length(text)
    lo, hi = F.least(begin, n), F.least(F.greatest(end, begin), n)
    pad = lambda k: F.repeat(F.lit(" "), k)
    return F.concat(pad(lo), F.substring(text, lo + 1, hi - lo), pad(n - hi))


def escaped(text: Column) -> Column:
    """Text as the content of passage markup."""
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def section(position: Column, content: Column) -> Column:
    return F.concat(F.lit('<p data-id="'), position, F.lit('">'), content, F.lit("</p>"))


def plain_to_markup(text: Column) -> Column:
    return section(F.lit("undefined"), escaped(text))


def decoded(text: Column) -> Column:
    """Entities of XML resolved: numeric ones first in place, then the named ones, ``&amp;`` last."""
    hexadecimal = lambda e: F.conv(F.regexp_extract(e, "&#[xX]([0-9a-fA-F]+);", 1), 16, 10)
    code = lambda e: F.when(e.rlike("^&#[xX]"), hexadecimal(e)).otherwise(
        F.regexp_extract(e, "&#([0-9]+);", 1)
    ).try_cast("long")
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    usable = lambda e: let(code(e), lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF))
    # A literal ampersand written as a number must not start an entity of the later steps.
    marked = lambda e: let(code(e), lambda c: F.when(c == 38, F.lit("&amp;")).otherwise(char(c)))
    entities = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]+|[xX][0-9a-fA-F]+);"), F.lit(0)))
    numeric = F.aggregate(
        F.filter(entities, usable), text, lambda acc, e: F.replace(acc, e, marked(e))
    )
    result = F.when(text.contains("&#"), numeric).otherwise(text)
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        result = F.replace(result, F.lit(f"&{name};"), F.lit(value))
    return result


def markup_to_plain(markup: Column) -> Column:
    """Passage markup as plain text: the sections with white space collapsed, joined by a space, empty ones left out.

    What is no well-formed markup stays as it is: every tag closed in order, empty elements and comments anywhere, nested
    to any depth.
    """
    bare = F.regexp_replace(markup, "(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(bare, F.lit("<[^<>]*>"), F.lit(0))
    name = lambda t: F.regexp_extract(t, "^</?([A-Za-z_][\\w.:-]*)", 1)
    opened = F.array().cast("array<string>")

    def step(stack, tag):
        """The names of open elements, null once a tag doesn't fit."""
        top = F.element_at(stack, -1)
        closed = F.when((F.size(stack) > 0) & (top == name(tag)), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
        return (
            F.when(tag.rlike("^</[A-Za-z_][\\w.:-]*\\s*>$"), closed)
            .when(tag.rlike("^<[A-Za-z_][\\w.:-]*(?:\\s[^<>]*)?/>$"), stack)
            .when(tag.rlike("^<[A-Za-z_][\\w.:-]*(?:\\s[^<>]*)?>$"), F.concat(stack, F.array(name(tag))))
        )

    balanced = F.coalesce(F.size(F.aggregate(tags, opened, step)) == 0, F.lit(False))
    text = F.regexp_replace(bare, "<[^<>]*>", "")
    is_markup = balanced & ~text.rlike("[<>]") & ~text.rlike("&(?!#|lt;|gt;|amp;|quot;|apos;)")
    normal = lambda s: F.trim(F.regexp_replace(decoded(F.regexp_replace(s, "<[^>]*>", "")), "[ \\t\\n\\r]+", " "))
    sections = F.filter(F.transform(F.split(bare, "(?<=</p>)"), normal), lambda s: s != "")
    return F.when(is_markup, F.array_join(sections, " ")).otherwise(markup)


# --- patterns of book names and passages --------------------------------------------------------------------------------


def _spellings(letter: str) -> str:
    """A letter of a name with what OCR reads it as."""
    read = [r for r, right in fixed.MISREAD if right == letter]
    return f"[{letter}{''.join(read)}]" if read else letter


def _trie(names: list[str]) -> dict:
    root: dict = {}
    for name in names:
        node = root
        for letter in name:
            node = node.setdefault(letter, {})
        node[""] = {}
    return root


def _alternatives(node: dict, dropped: str) -> str:
    """A prefix tree as a pattern; dropped characters may stand between two letters, the shorter name goes first."""
    options = [""] if "" in node else []
    longer = [_spellings(letter) + _alternatives(child, dropped) for letter, child in node.items() if letter]
    if longer:
        either = longer[0] if len(longer) == 1 else f"(?:{'|'.join(longer)})"
        options.append(f"[{dropped}]*+{either}")
    return options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"


def _names(names: list[str], dropped: str) -> str:
    return f"(?:{'|'.join(_spellings(c) + _alternatives(child, dropped) for c, child in _trie(names).items())})"


@lru_cache(maxsize=None)
def name_pattern(lang: str, dropped: str = DROPPED) -> str:
    names = [n for _, n in fixed.names_of(lang)]
    return _names(names, dropped)


def spelled_name(lang: str) -> str:
    """:func:`name_pattern` in few characters."""
    return name_pattern(lang, _DROPPED)


@lru_cache(maxsize=None)
def first_letters(lang: str) -> str:
    return "".join(sorted({c for _, n in fixed.names_of(lang) for c in _spellings(n[0]).strip("[]")}))


@lru_cache(maxsize=None)
def numbered_name(lang: str) -> str:
    """Where a name starting with a digit begins, which takes its digit back from the passage before it.

    For looking ahead only: of two names of which one begins with the other the shorter says it all.
    """
    names = [n for _, n in fixed.names_of(lang) if n[0].isdigit()]
    shortest = [n for n in names if not any(n != m and n.startswith(m) for m in names)]
    return f"(?=[0-9]){_names(shortest, _DROPPED)}"


def _digit(lang: str) -> str:
    return f"(?:(?!{numbered_name(lang)})[0-9])"


@lru_cache(maxsize=None)
def number_pattern(lang: str) -> str:
    """A number up to uint32.

    A digit that begins a name has a letter behind it, so only the last digit of a larger number can be one.
    """
    d = _digit(lang)
    limit = str(fixed.MAX_UINT32)
    larger, whole = ["[1-9][0-9]{9}"], []
    for i, c in enumerate(limit):
        if c != "9":
            rest = len(limit) - i - 1
            above = limit[:i] + f"[{int(c) + 1}-9]"
            (larger if rest else whole).append(above + (f"[0-9]{{{rest - 1}}}" if rest > 1 else ""))
    return f"(?!0*+(?:{'|'.join([f'(?:{"|".join(larger)}){d}', *whole])})){d}++"


@lru_cache(maxsize=None)
def passage_pattern(lang: str) -> str:
    """The text of a passage from its first separator or number to its last number."""
    gap = f"(?>ff\\.|f\\.|[{fixed.POSTFIX_LETTERS}]|[{_WS}])"
    sep = f"[,;.:&+{_LINE}]"
    bridging = f"[,;:&+{_LINE}]"
    n = number_pattern(lang)
    leading = f"(?:{gap}*+{sep})*+"
    return f"{leading}{n}(?:{gap}*+(?:\\.{leading}|{bridging}{leading}{gap}*+){n})*+"


@lru_cache(maxsize=None)
def citation_pattern(lang: str) -> str:
    """A book name followed by digits before the next word, with its passage if it has one.

    It is kept short: Spark compares a pattern with the one before for every row, and each task reads it anew.
    """
    letters = fixed.LETTERS[lang]
    # One class and possessive: a loop without backtracking, however long the run before the digit is.
    digits_follow = f"(?=[[^{letters}0-9]{fixed.POSTFIX_LETTERS}]*+[0-9])"
    # Behind all names once: where it fails, the next longer name is tried.
    name = spelled_name(lang) + digits_follow
    return f"(?=[{first_letters(lang)}])(?>{name})(?:[{_DROPPED}]*+{passage_pattern(lang)})?"
