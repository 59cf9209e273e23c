"""Whitespace, tokens and token hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space: the ASCII controls and separators,
# the blank, and the Unicode spaces.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words by the Unicode default rules: letters, digits and underscores run together;
# some punctuation joins two letters (node.js, don't) or two digits (3.14, 1,000);
# Han and Hiragana characters are words of their own. Possessive repeats keep Java's
# matcher from recursing, so that a junk "word" of any length is safe.
# A script is looked up for every character it is asked of, so both classes ask first what is cheap:
# no Han or Hiragana character comes before U+2E80.
SINGLE = r"[\x{2E80}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}]]"
RUN = rf"[a-z0-9_[\p{{L}}\p{{M}}\p{{N}}&&[^{SINGLE}]]]"
JOINT = r"(?<=[\p{L}\p{M}])[:.'’·‧](?=\p{L})|(?<=\p{N})[,;.'’](?=\p{N})"
WORD = rf"{SINGLE}|_*[\p{{L}}\p{{N}}]{RUN}*+(?:(?:{JOINT}){RUN}++)*+"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` only removes blanks)."""
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def normal_tokens(items: Column) -> Column:
    """Distinct items after lower-casing and stripping, blanks dropped."""
    cleaned = F.transform(items, lambda item: strip(F.lower(item)))
    return F.array_distinct(F.filter(cleaned, lambda item: item != ""))
