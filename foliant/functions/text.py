"""Text analysis as built-in expressions: folding, word splitting, phrase and word tests, markup cleaning.

A text field is compared word by word. ``fold`` lower-cases and strips diacritics except those of å, ä and ö;
``analyze`` splits the folded text into words. Everything is a JVM-side expression, so scans keep code generation
and no text crosses to Python.

The word pattern follows the Unicode word-break rules for alphabetic scripts (letters, digits and underscores, with
``'``, ``.``, ``:`` or ``·`` kept between letters and ``.``, ``,``, ``;`` or ``'`` between digits); ideographs and
hiragana are one word each.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters folded to å, ä and ö before any other folding, and the letters that keep their marks.
TO_AA = "Ǻǻ"
TO_AE = "æÆǞǟ"
TO_OE = "ØøŒœȪȫŐőÕõṌṍṎṏȬȭǾǿǬǭŌōṒṓṐṑ"
KEPT = "åäöÅÄÖ"

# Letters that fold to more than one letter.
EXPANSIONS = (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))


def _word(letter: str) -> str:
    return rf"{letter}+(?:(?<=\p{{L}})['’.:·](?=\p{{L}}){letter}+|(?<=\p{{N}})[.,;'’](?=\p{{N}}){letter}+)*"


# intersecting character classes is slow, so the pattern that splits ideographs is kept for texts that hold some
IDEOGRAPH = r"[\p{IsHan}\p{IsHiragana}]"
WORD = _word(r"[\p{L}\p{N}_]")
WORD_OR_IDEOGRAPH = IDEOGRAPH + "|" + _word(rf"[\p{{L}}\p{{N}}_&&[^{IDEOGRAPH[1:-1]}]]")
MAY_HOLD_IDEOGRAPHS = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{1b000}-\x{3ffff}]"


@functools.cache
def _folding() -> tuple[str, str]:
    """Characters and what each folds to, from the Unicode decompositions; trailing characters are deleted."""
    table: dict[str, str] = {}
    for target, letters in (("å", TO_AA), ("ä", TO_AE), ("ö", TO_OE)):
        table.update({c.lower(): target for c in letters})
    for code in [*range(0xAA, 0x2100), *range(0xFF01, 0xFF5F)]:
        char = chr(code)
        if char in KEPT or char in table or char.lower() != char or not char.isalnum():
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
        if len(base) != 1 or base == char:
            name = unicodedata.name(char, "")
            stem = name.removesuffix(" WITH STROKE")
            if stem == name or not stem.startswith("LATIN SMALL LETTER ") or len(stem.split()) != 4:
                continue
            base = stem[-1].lower()
        table[char] = base
    deleted = "-" + "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(table) + deleted, "".join(table.values())


def fold(col: Column) -> Column:
    """Lower-cased text without hyphens and without diacritics other than those of å, ä and ö."""
    out = F.lower(col)
    for decomposed, composed in (("å", "å"), ("ä", "ä"), ("ö", "ö")):
        out = F.replace(out, F.lit(decomposed), F.lit(composed))
    out = F.translate(out, *_folding())
    for letter, letters in EXPANSIONS:
        out = F.replace(out, F.lit(letter), F.lit(letters))
    return out


def analyze(col: Column) -> Column:
    """The words of a text, in order."""
    plain = F.regexp_extract_all(fold(col), F.lit(WORD), F.lit(0))
    mixed = F.regexp_extract_all(fold(col), F.lit(WORD_OR_IDEOGRAPH), F.lit(0))
    return F.when(F.rlike(col, F.lit(MAY_HOLD_IDEOGRAPHS)), mixed).otherwise(plain)


def raw(col: Column) -> Column:
    """The unanalysed value of a text field, used for value statistics."""
    return col


def sv_sort(col: Column) -> Column:
    """A text ordered by Swedish rules."""
    return F.collate(col, "sv")


def joined(words: Column) -> Column:
    """Words as one string with a space on both sides of each; words never contain a space."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def words_contain_phrase(words: Column, phrase_words: Column) -> Column:
    """Whether ``phrase_words`` is a contiguous run of ``words``; an empty phrase is found nowhere."""
    return (F.size(phrase_words) > 0) & F.contains(joined(words), joined(phrase_words))


def text_contains_phrase(col: Column, phrase: Column) -> Column:
    """Phrase test on unanalysed text. The folded text is searched for the first word before it is split, so that
    the costlier split runs on candidate rows only."""
    wanted = analyze(phrase)
    candidate = F.contains(fold(col), F.coalesce(F.get(wanted, F.lit(0)), F.lit("")))
    return (F.size(wanted) > 0) & candidate & words_contain_phrase(analyze(col), wanted)


def any_word_starts(words: Column, start: str) -> Column:
    return F.lit(False) if " " in start else F.contains(joined(words), F.lit(f" {start}"))


def any_word_ends(words: Column, end: str) -> Column:
    return F.lit(False) if " " in end else F.contains(joined(words), F.lit(f"{end} "))


def any_word_contains(words: Column, part: str) -> Column:
    return F.lit(False) if " " in part else F.contains(F.array_join(words, " "), F.lit(part))


def any_word_matches(words: Column, pattern: str) -> Column:
    """A regular expression (Java syntax) that has to match some word completely."""
    return F.exists(words, lambda w: F.rlike(w, F.lit(f"^(?:{pattern})$")))


def ngrams(words: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- markup

_UNICODE_WORD = r"\p{L}\p{N}_"


def clean_refs(col: Column) -> Column:
    """``+word(refid=x)`` becomes ``word``."""
    return F.regexp_replace(col, rf"\+([{_UNICODE_WORD}\- ]*)\(refid=[{_UNICODE_WORD}]*\)", "$1")


def clean_tags(col: Column) -> Column:
    """``[i text]`` becomes ``text`` (letters, digits, spaces and simple punctuation only)."""
    return F.regexp_replace(col, rf"\[i ([{_UNICODE_WORD}\x20-\x30]*)\]", "$1")


def extract_segments(col: Column) -> Column:
    """All ``name="..."`` values and all ``<e ..>`` bodies of a marked-up text, as two arrays."""
    return F.struct(
        F.regexp_extract_all(col, F.lit(rf'name="([{_UNICODE_WORD}]+)">'), F.lit(1)).alias("lemmata"),
        F.regexp_extract_all(col, F.lit(r"(?d)<e.*?>(.+?)</e>"), F.lit(1)).alias("wordforms"),
    )
