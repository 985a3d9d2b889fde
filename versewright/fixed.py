"""Names, codes, character lists and tables results depend on.

Everything here is plain data in its natural order.  Tables that follow from a rule (aliases, URL book codes,
the KJV numbering) are computed where they are used.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

# --- fixed values: the books in canon order, identifier and USFM code ------------------------------------------------
BOOKS = [
    ("genesis", "GEN"), ("exodus", "EXO"), ("leviticus", "LEV"), ("numbers", "NUM"), ("deuteronomy", "DEU"),
    ("joshua", "JOS"), ("judges", "JDG"), ("ruth", "RUT"), ("samuel1", "1SA"), ("samuel2", "2SA"),
    ("kings1", "1KI"), ("kings2", "2KI"), ("chronicles1", "1CH"), ("chronicles2", "2CH"), ("ezra", "EZR"),
    ("nehemiah", "NEH"), ("esther", "EST"), ("job", "JOB"), ("psalms", "PSA"), ("proverbs", "PRO"),
    ("ecclesiastes", "ECC"), ("song_of_solomon", "SNG"), ("isaiah", "ISA"), ("jeremiah", "JER"),
    ("lamentations", "LAM"), ("ezekiel", "EZK"), ("daniel", "DAN"), ("hosea", "HOS"), ("joel", "JOL"),
    ("amos", "AMO"), ("obadiah", "OBA"), ("jonah", "JON"), ("micah", "MIC"), ("nahum", "NAM"),
    ("habakkuk", "HAB"), ("zephaniah", "ZEP"), ("haggai", "HAG"), ("zechariah", "ZEC"), ("malachi", "MAL"),
    ("matthew", "MAT"), ("mark", "MRK"), ("luke", "LUK"), ("john", "JHN"), ("acts", "ACT"), ("romans", "ROM"),
    ("corinthians1", "1CO"), ("corinthians2", "2CO"), ("galatians", "GAL"), ("ephesians", "EPH"),
    ("philippians", "PHP"), ("colossians", "COL"), ("thessalonians1", "1TH"), ("thessalonians2", "2TH"),
    ("timothy1", "1TI"), ("timothy2", "2TI"), ("titus", "TIT"), ("philemon", "PHM"), ("hebrews", "HEB"),
    ("james", "JAS"), ("peter1", "1PE"), ("peter2", "2PE"), ("john1", "1JN"), ("john2", "2JN"), ("john3", "3JN"),
    ("jude", "JUD"), ("revelation", "REV"),
]

# --- fixed values: how each book is written, a line per book in canon order -------------------------------------------
NAMES_EN = """
Genesis Gen
Exodus Exod Ex
Leviticus Lev
Numbers Num
Deuteronomy Deut Dt
Joshua Josh
Judges Judg
Ruth
1Samuel 1Sam
2Samuel 2Sam
1Kings 1Kgs
2Kings 2Kgs
1Chronicles 1Chr
2Chronicles 2Chr
Ezra Ezr
Nehemiah Neh
Esther Esth
Job
Psalms Ps Psalm
Proverbs Prov
Ecclesiastes Eccl
SongofSolomon Song SoS
Isaiah Isa
Jeremiah Jer
Lamentations Lam
Ezekiel Ezek
Daniel Dan
Hosea Hos
Joel
Amos Am
Obadiah Obad
Jonah Jon
Micah Mic
Nahum Nah
Habakkuk Hab
Zephaniah Zeph
Haggai Hag
Zechariah Zech
Malachi Mal
Matthew Matt Mt
Mark Mk
Luke Lk
John Jn
Acts
Romans Rom
1Corinthians 1Cor
2Corinthians 2Cor
Galatians Gal
Ephesians Eph
Philippians Phil
Colossians Col
1Thessalonians 1Thess
2Thessalonians 2Thess
1Timothy 1Tim
2Timothy 2Tim
Titus Tit
Philemon Phlm
Hebrews Heb
James Jas
1Peter 1Pet
2Peter 2Pet
1John 1Jn
2John 2Jn
3John 3Jn
Jude Jud
Revelation Rev
"""
NAMES_DE = """
Genesis 1Mose Gen 1Mo
Exodus 2Mose Ex 2Mo
Levitikus 3Mose Lev 3Mo
Numeri 4Mose Num 4Mo
Deuteronomium 5Mose Dtn 5Mo
Josua Jos
Richter Ri
Rut
1Samuel 1Sam
2Samuel 2Sam
1Könige 1Kön 1Kö
2Könige 2Kön 2Kö
1Chronik 1Chr
2Chronik 2Chr
Esra Esr
Nehemia Neh
Ester Est
Hiob Hi
Psalm Ps
Sprüche Spr
Prediger Pred
Hohelied Hhld Hld
Jesaja Jes
Jeremia Jer
Klagelieder Klgl
Hesekiel Hes
Daniel Dan
Hosea Hos
Joel
Amos Am
Obadja Obd
Jona
Micha Mi
Nahum Nah
Habakuk Hab
Zefanja Zef
Haggai Hag
Sacharja Sach
Maleachi Mal
Matthäus Mt
Markus Mk
Lukas Lk
Johannes Joh
Apostelgeschichte Apg
Römer Röm
1Korinther 1Kor
2Korinther 2Kor
Galater Gal
Epheser Eph
Philipper Phil
Kolosser Kol
1Thessalonicher 1Thess
2Thessalonicher 2Thess
1Timotheus 1Tim
2Timotheus 2Tim
Titus Tit
Philemon Phlm
Hebräer Hebr
Jakobus Jak
1Petrus 1Petr
2Petrus 2Petr
1Johannes 1Joh
2Johannes 2Joh
3Johannes 3Joh
Judas Jud
Offenbarung Offenb Offb
"""

# --- fixed values: characters OCR misreads, read -> meant --------------------------------------------------------------
MISREAD = [("0", "o"), ("I", "1"), ("l", "1"), ("m", "M"), ("O", "o"), ("s", "S"), ("S", "s")]

# --- fixed values: character lists -------------------------------------------------------------------------------------
LETTERS = {"en": "A-Za-z", "de": "A-Za-zÄäÖöÜü"}
# White space of the text scan and of the markup readers.
WHITESPACE_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F,
    0x205F, 0x2060, 0x3000, 0xFEFF,
]
LINE_CODES = [0x2D, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0xFE58, 0xFE63, 0xFF0D]
POSTFIX_LETTERS = "fabcd"
MAX_UINT32 = 4294967295
LONGEST_CHAPTER = 176

# --- fixed values: markup styles ---------------------------------------------------------------------------------------
TEXT_FREE_STYLES = ["h", "toc", "mt", "s", "ms", "sd", "sp", "r", "sr", "mr", "d", "cl", "cd", "rem"]
INLINE_TAGS = {"bd": "b", "it": "i", "em": "i", "nd": "i", "add": "i"}
NAME_FORMS = {
    "abbreviation": ["toc3", "h", "toc2"],
    "short_name": ["toc2", "h", "toc1"],
    "long_name": ["toc1", "mt1", "mt", "toc2"],
}
PARAGRAPH_MARKERS = (
    "ide sts rem h toc toca imt is ip ipi im imi ipq imq ipr ipc iq ili ib iot io iex imte ie mt mte cl cd ms mr s sr "
    "r d sp sd p m po cls pr pc pm pmo pmc pmr pi mi lit nb b ph q qr qc qa qm qd lh li lf lim cp"
).split()
NOTE_SECTION_MARKERS = "fr fq fqa fk ft fl fw fp fv fdc fm xo xop xk xq xt xta xot xnt xdc".split()
CELL_MARKERS = ["th", "thr", "thc", "tc", "tcr", "tcc"]
DEFAULT_ATTRIBUTES = {"w": "lemma", "rb": "gloss", "xt": "link-href", "jmp": "link-href", "ref": "loc"}
RENAMED_ATTRIBUTES = {"src": "file"}

# --- fixed values: lookup sites ----------------------------------------------------------------------------------------
BIBLE_COM = [
    ("Lutherbibel 1912", 51, "DELUT"), ("Elberfelder 1905", 57, "ELB"), ("Elberfelder 1871", 58, "ELB71"),
    ("Hoffnung für alle", 73, "HFA"), ("Neue Genfer Übersetzung", 108, "NGU2011"), ("Schlachter 2000", 157, "SCH2000"),
    ("English Standard Version", 59, "ESV"), ("King James Version", 1, "KJV"),
    ("New American Standard Bible 1995", 100, "NASB1995"), ("New International Version", 111, "NIV"),
    ("New King James Version", 114, "NKJV"), ("New Living Translation", 116, "NLT"),
]
BIBLESERVER = [
    ("Das Buch", "DBU"), ("Einheitsübersetzung", "EU"), ("Elberfelder Bibel", "ELB"),
    ("English Standard Version", "ESV"), ("Gute Nachricht Bibel", "GNB"), ("Hoffnung für alle", "HFA"),
    ("King James Version", "KJV"), ("Lutherbibel", "LUT"), ("Menge Bibel", "MENG"),
    ("Neue evangelistische Übersetzung", "NeÜ"), ("Neue Genfer Übersetzung", "NGÜ"), ("Neues Leben. Die Bibel", "NLB"),
    ("New International Reader's Version", "NIRV"), ("New International Version", "NIV"), ("Schlachter", "SLT"),
    ("Volxbibel", "VXB"), ("Zürcher Bibel", "ZB"),
]
LOOKUP_DEFAULTS = {
    "bible_com": {"english": ["New International Version"], "german": ["Elberfelder 1905"]},
    "bibleserver": {
        "english": ["New International Version", "English Standard Version"],
        "german": ["Neue Genfer Übersetzung", "Elberfelder Bibel"],
    },
}
# Names in the URLs of bibleserver where they are not the first German name of the book.
BIBLESERVER_SPELLING = {
    "genesis": "1.Mose", "exodus": "2.Mose", "leviticus": "3.Mose", "numbers": "4.Mose", "deuteronomy": "5.Mose",
    "song_of_solomon": "Hoheslied",
}

# --- fixed values: defaults of the citation mask and of dwell detection -------------------------------------------------
DEFAULT_MASKS = {
    "german": '"[content]" ({[book][nbsp]}[#chapter_begin], [#verse_begin]'
              "{[nbsp]- {[book_end] }{[#chapter_end],}[#verse_end]}{ [scripture_abbr]})",
    "english": '"[content]" ({[book][nbsp]}[#chapter_begin]: [#verse_begin]'
               "{[nbsp]- {[book_end] }{[#chapter_end]:}[#verse_end]}{ [scripture_abbr]})",
}
POLL_MS, DWELL_MS, TOLERANCE_PX = 250, 700, 8
MIN_POLL_MS, MIN_DWELL_MS, MIN_TOLERANCE_PX = 50, 100, 0


def class_of(codes: list[int]) -> str:
    """The inside of a regular-expression character class for code points."""
    return "".join(f"\\x{{{c:X}}}" for c in codes)


def ranges_of(codes: list[int]) -> str:
    """:func:`class_of` in few characters: neighbours as a range, characters beyond Latin-1 as they are."""
    shown = lambda c: f"\\x{c:02X}" if c < 256 else chr(c)
    starts = [c for c in sorted({*codes}) if c - 1 not in codes]
    ends = [c for c in sorted({*codes}) if c + 1 not in codes]
    return "".join(shown(a) if a == b else f"{shown(a)}-{shown(b)}" for a, b in zip(starts, ends))


@lru_cache(maxsize=None)
def names_of(lang: str) -> list[tuple[int, str]]:
    """``(book_ord, name)`` in listed order, books counted from 1."""
    lines = (NAMES_EN if lang == "en" else NAMES_DE).strip().splitlines()
    return [(book, name) for book, line in enumerate(lines, 1) for name in line.split()]


@lru_cache(maxsize=None)
def last_verses(vers_name: str) -> list[list[int]]:
    """Last verse of every chapter of every book.  The KJV ends 3 John with verse 14, the ESV with 15."""
    text = (resources.files(__package__) / "data" / "last_verses.txt").read_text("utf-8")
    books = [[int(n) for n in line.split()[1:]] for line in text.splitlines() if line and not line.startswith("#")]
    if vers_name == "kjv":
        books[[book for book, _ in BOOKS].index("john3")] = [14]
    return books


VERSIFICATIONS = ("esv", "kjv")


def bibleserver_book(book_ord: int) -> str:
    """Name of a book in bibleserver URLs: the first German one, a leading number set off by a full stop."""
    book_id = BOOKS[book_ord - 1][0]
    name = next(n for b, n in names_of("de") if b == book_ord)
    return BIBLESERVER_SPELLING.get(book_id, f"{name[0]}.{name[1:]}" if name[0].isdigit() else name)
