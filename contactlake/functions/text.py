"""Text helpers shared by the cleaners."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode white space characters stripped from both ends.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITE_SPACE_RUN = f"[{WHITE_SPACE}]+"

# The emoji class removed from names.
EMOJI_RUN = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2764}\x{FE0F}]+"

# Marks a word start that is not preceded by a blank (see title_case).
_MARK = "\x01 "


def strip(c: Column) -> Column:
    """Remove white space (all of Unicode's, not only U+0020) from both ends."""
    return F.trim(c, F.lit(WHITE_SPACE))


def is_ascii(c: Column) -> Column:
    """True when every character is a single byte; no scan of the pattern kind."""
    return F.octet_length(c) == F.char_length(c)


def compose(c: Column, compat: bool) -> Column:
    """Unicode NFKC (``compat``) or NFC, evaluated in the JVM.

    Spark has no built-in normalizer, but ships the ICU library for its
    collations and can call a static method of it. Only rows that are not
    plain ASCII reach the call.
    """
    normalized = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(compat)
    )
    return F.when(c.isNull() | is_ascii(c), c).otherwise(normalized)


def title_case(c: Column) -> Column:
    """Upper-case every letter that does not follow a cased letter.

    ``initcap`` starts words at blanks only; a marked blank after each
    non-cased character makes it start them after quotes, hyphens and digits
    too ("O'Brien", "Mary-Ann").
    """
    marked = F.regexp_replace(
        F.lower(c), r"([^\p{IsUppercase}\p{IsLowercase}\p{Lt}])", "$1" + _MARK
    )
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def one_case(c: Column) -> Column:
    """True when the cased letters are all upper or all lower, and there is one."""
    upper, lower = F.upper(c), F.lower(c)
    plain = ((upper == c) | (lower == c)) & (upper != lower)
    # beyond ASCII there are cased letters without a counterpart
    by_property = (c.rlike(r"\p{IsUppercase}") != c.rlike(r"\p{IsLowercase}")) & ~c.rlike(r"\p{Lt}")
    return F.when(is_ascii(c), plain).otherwise(by_property)


def words(c: Column) -> Column:
    return F.split(c, WHITE_SPACE_RUN)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal table, NULL when absent."""
    literals = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*literals), key)
