"""Value normalisers as native column expressions.

Whitespace, digits and letter case follow the Unicode rules of the contact files'
producers, which are wider than Spark's ``trim``, ``\\d`` and ``initcap``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contactloom.config import DEFAULT, Config

# The characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Text that composition may change holds a combining mark, a conjoining Hangul letter, or
# a character of the blocks that have another canonical form. Wider than needed, never
# narrower (a test goes through all code points).
_NFC_CANDIDATE = (
    r"[\p{M}\u0340-\u0387\u0958-\u0A5E\u0B5C\u0B5D\u0F43-\u0FB9\u1100-\u11FF"
    r"\u1F71-\u1FFD\u2000\u2001\u2126-\u212B\u2329\u232A\u2ADC\uF900-\uFB4E"
    r"\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)

_CASED_RUNS = r"([\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+)"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def plain(c: Column) -> Column:
    """Printable ASCII without outer blanks: text that cleaning leaves as it is. Most
    values are, and one pass over them saves the others."""
    return c.rlike(r"^[!-~](?:[ -~]*[!-~])?$")


def blank(c: Column) -> Column:
    """Null, empty or white space only. A visible ASCII character settles it at once."""
    return F.coalesce(~c.rlike("[!-~]") & (strip(c) == ""), F.lit(True))


def null_blank(c: Column) -> Column:
    """Blank text becomes null; other text is kept as it is."""
    return F.when(~blank(c), c)


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")


def clean(c: Column) -> Column:
    """Strip, then drop control characters; empty becomes null."""
    return F.when(plain(c), c).otherwise(F.nullif(drop_control(strip(c)), F.lit("")))


def match_form(c: Column) -> Column:
    """The form in which two values are compared: stripped, lower case, null if blank."""
    # ASCII without outer blanks needs no stripping, which is slower than this test.
    return F.when(c.rlike(r"^[!-~](?:[ -~]*[!-~])?\z"), F.lower(c)).otherwise(F.nullif(F.lower(strip(c)), F.lit("")))


def email(c: Column) -> Column:
    return match_form(c)


def phone(c: Column) -> Column:
    """Digits of any script and every plus sign."""
    return F.nullif(F.regexp_replace(c, r"[^\p{Nd}+]", ""), F.lit(""))


def title(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(_CASED_RUNS), F.lit(1)), F.initcap)
    # Where only blanks part the runs, the built-in does the same.
    return F.when(c.rlike("^[A-Za-z ]+$"), F.initcap(c)).otherwise(F.array_join(runs, ""))


def single_case(c: Column) -> Column:
    """Holds a letter with case, and all such letters are of the same case."""
    upper, lower, titled = c.rlike(r"\p{IsUppercase}"), c.rlike(r"\p{IsLowercase}"), c.rlike(r"\p{Lt}")
    return (upper != lower) & ~titled


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode composition. Spark has no such function; only text that can change is sent
    to Python, all other values reach the Arrow batch as nulls."""
    may_change = (F.octet_length(c) != F.length(c)) & c.rlike(_NFC_CANDIDATE)
    return F.coalesce(_compose(F.when(may_change, c)), c)


def name_base(c: Column) -> Column:
    """Composed, without control characters, stripped: what the letter-case rule looks at."""
    return F.when(plain(c), c).otherwise(strip(drop_control(nfc(c))))


def name_case(base: Column) -> Column:
    """Title case for names written in one case; others keep theirs. Empty becomes null."""
    return F.nullif(F.when(single_case(base), title(base)).otherwise(base), F.lit(""))


def name(c: Column) -> Column:
    return name_case(name_base(c))


def country(c: Column, config: Config = DEFAULT) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in config.country_codes.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.lower(strip(c))), F.nullif(F.upper(strip(c)), F.lit("")))


def status_label(c: Column, labels: dict) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def like_pattern(text: str) -> str:
    """Case-insensitive containment; ``%`` and ``_`` in the text stay wildcards."""
    return f"%{text}%"
