"""E-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contactlake import vocab
from contactlake.functions import text
from contactlake.functions.layers import Recipe

MISSING, INVALID, JUNK = "email_missing", "email_invalid", "email_junk"
TYPO_PREFIX = "email_typo_domain:"

# Address syntax: dot-separated atoms, then a dotted domain of at most 63
# characters per label whose last label ends in a letter. Characters beyond
# ASCII are allowed on both sides (internationalised mail).
_ATOM = r"[a-z0-9!#$%&'*+/=?^_`{|}~\x{A1}-\x{10FFFF}-]+"
_WORD = r"a-z0-9\x{A1}-\x{10FFFF}"
_LABEL = rf"[{_WORD}](?:[{_WORD}-]{{0,61}}[{_WORD}])?"
_LAST_LABEL = rf"(?:[{_WORD}][{_WORD}-]{{0,61}})?[a-z\x{{A1}}-\x{{10FFFF}}]"
ADDRESS = rf"^{_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+{_LAST_LABEL}$"
#: a label may not have hyphens in third and fourth place, punycode excepted
RESERVED_LABEL = r"[@.](?!xn)..--"


def domain_of(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def is_address(c: Column) -> Column:
    """Syntax test; lengths first so the patterns only see short input."""
    local_length = F.char_length(F.substring_index(c, "@", 1))
    return (
        F.when(F.char_length(c) > 254, F.lit(False))
        .when(local_length > 64, F.lit(False))
        .when(F.substring_index(c, ".", -1).isin(*vocab.SPECIAL_USE_TLDS), F.lit(False))
        .when(F.contains(c, F.lit("--")) & c.rlike(RESERVED_LABEL), F.lit(False))
        .otherwise(c.rlike(ADDRESS))
    )


def email_recipe(raw: Column, out: str) -> Recipe:
    """Columns ``out``, ``{out}_typo`` (soft flag) and ``{out}_flag`` (hard flag)."""
    whole, low, dom, fix, addr, ok = (
        f"_{out}_{step}" for step in ("whole", "low", "dom", "fix", "addr", "ok")
    )
    LOW, DOM, FIX, ADDRESS_, OK = (F.col(c) for c in (low, dom, fix, addr, ok))
    junk = F.coalesce(FIX, DOM).isin(*vocab.JUNK_EMAIL_DOMAINS) | F.substring_index(
        ADDRESS_, "@", 1
    ).isin(*vocab.JUNK_EMAIL_LOCALS)
    return Recipe(
        compose={whole: text.compose(raw, compat=False)},
        layers=[
            {low: F.lower(text.strip(F.col(whole)))},
            {dom: F.when(F.contains(LOW, F.lit("@")), domain_of(LOW)).otherwise(F.lit(""))},
            {fix: text.lookup(vocab.TYPO_DOMAINS, DOM)},
            {
                addr: F.when(
                    FIX.isNotNull(),
                    F.concat(F.left(LOW, F.char_length(LOW) - F.char_length(DOM)), FIX),
                ).otherwise(LOW)
            },
            {ok: F.when(ADDRESS_ != "", is_address(ADDRESS_))},
            {
                out: F.when(OK, ADDRESS_),
                f"{out}_typo": F.when(OK & FIX.isNotNull(), F.concat(F.lit(TYPO_PREFIX), DOM)),
                f"{out}_flag": F.when(OK.isNull(), F.lit(MISSING))
                .when(~OK, F.lit(INVALID))
                .when(junk, F.lit(JUNK)),
            },
        ],
    )
