"""Names in their plain form by Catalyst functions alone: a two-level trie of code points in place of Python's unicodedata.

PAGES holds for each 256 code points the number of their leaf, LEAVES for each code point of a leaf what it becomes: NFC, case
folded, NFKD, without combining marks. Code points in no leaf stay as they are. Both are computed from Python's tables when first
asked for, and go into the plan as two literal arrays; a look-up of a code point is two array accesses.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond it no code point has a decomposition.
LAST = 0x2FFFF
# fixed values: dashes become blanks, these marks are dropped
DASHES, MARKS = "-–—", ".,;:!?'\"()[]{}/\\"
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def bare(char: str) -> str:
    """What one character becomes."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", char).casefold())
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


@cache
def trie() -> tuple[list[int], list[str]]:
    """PAGES (-1: no leaf) and LEAVES."""
    pages, leaves = [], []
    for page in range((LAST >> 8) + 1):
        own = [chr(cp) for cp in range(page << 8, (page + 1) << 8)]
        told = [c if 0xD800 <= ord(c) < 0xE000 else bare(c) for c in own]
        if told == own:
            pages.append(-1)
        else:
            pages.append(len(leaves) >> 8)
            leaves += told
    return pages, leaves


def without_marks(text: Column) -> Column:
    """Case folded, without accents and compatibility forms."""
    pages, leaves = trie()
    page_of = F.split(F.lit(",".join(map(str, pages))), ",").cast("array<int>")
    told = [x if not 0xD800 <= ord(x[:1] or " ") < 0xE000 else "?" for x in leaves]  # half characters can't be in a text
    leaf_of = F.split(F.lit("\0|".join(told)), "\0[|]")

    def one(char: Column) -> Column:
        code = F.ascii(char)
        page = F.get(page_of, F.shiftright(code, 8))
        return F.when(F.coalesce(page, F.lit(-1)) < 0, char).otherwise(F.get(leaf_of, page * 256 + code.bitwiseAND(F.lit(255))))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")


def plain_name(name: Column) -> Column:
    """Case folded, without accents and marks, dashes as blanks, single blanks; null stays null."""
    text = F.translate(without_marks(name), DASHES + MARKS, " " * len(DASHES))
    return F.btrim(F.regexp_replace(text, BLANKS, " "))
