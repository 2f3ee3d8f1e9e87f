"""Phone numbers to E.164, by number length.

Known deviation: the length tables of countries outside +1 are replaced by
the general bound of 7 to 15 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contactlake import vocab
from contactlake.functions import text
from contactlake.functions.layers import Recipe

MISSING, JUNK = "phone_missing", "phone_junk"
UNPARSEABLE, UNVERIFIED = "phone_unparseable", "phone_unverified"

#: country calling code of the supported default region
REGION_CODES = {"US": "1"}

# The calling codes of countries and services, as one pattern.
CALLING_CODE = (
    "^(?:1|7|2(?:0|7|1[1-368]|[2-4]|5[0-8]|6|9[01789])|3(?:[0-469]|5|7[0-8]|8[0-35-79])|4(?:[013-9]|2[013])"
    "|5(?:[1-8]|0|9)|6(?:[0-6]|7[02-9]|8[0-35-9]|9[0-2])|8(?:[1246]|0[08]|5[02356]|7[0-8]|8[0-368])"
    "|9(?:[0-58]|6[0-8]|7[0-79]|9[2-68]))"
)
EXTENSION = r"(?i)[\s,;]*(?:ext(?:ension|n)?|x|#|int)\s*[.:=]?\s*\d{1,7}#?$"
MAX_INPUT = 250
#: characters between digits that need no interpretation
PUNCTUATION = "+-(). /"
# The letters of a telephone keypad.
KEYPAD_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYPAD_DIGITS = "22233344455566677778889999"


def phone_recipe(raw: Column, out: str, region: str = "US") -> Recipe:
    """Columns ``out`` and ``{out}_flag``."""
    code = REGION_CODES[region]
    whole, s, digits, body, number, intl, nat, found = (
        f"_{out}_{step}"
        for step in ("whole", "s", "digits", "body", "number", "intl", "nat", "found")
    )
    S, DIGITS, BODY = F.col(s), F.col(digits), F.col(body)
    NUMBER, INTL, NAT, FOUND = F.col(number), F.col(intl), F.col(nat), F.col(found)

    def digits_of(c: Column) -> Column:
        return F.regexp_replace(c, "[^0-9]+", "")

    # Plain punctuation is deleted without a pattern; ``body`` is only set
    # where letters or other characters need a closer look.
    plain = F.translate(S, "0123456789" + PUNCTUATION, "") == ""
    keyed = digits_of(F.translate(F.upper(BODY), KEYPAD_LETTERS, KEYPAD_DIGITS))
    single_digit = F.replace(DIGITS, F.substring(DIGITS, 1, 1), F.lit("")) == ""
    size = F.char_length
    # After a +1: an 11-digit rest repeats the trunk prefix.
    home = F.when(
        (size(NAT) == 11) & F.startswith(NAT, F.lit(code)), F.substring(NAT, 2, 10)
    ).otherwise(NAT)
    # ten digits that a parser could read as a number of the region, if an impossible one
    national = (
        (size(DIGITS) == 10) & (size(S) <= MAX_INPUT)
        & (INTL.isNull() | F.startswith(INTL, F.lit(code)) | INTL.rlike(CALLING_CODE))
    )
    written = F.coalesce(BODY, S)
    has_plus = F.contains(written, F.lit("+")) & written.rlike(r"^[^0-9]*\+")
    return Recipe(
        # full-width digits and signs become ASCII ones
        compose={whole: text.compose(raw, compat=True)},
        layers=[
            {s: text.strip(F.col(whole))},
            {
                digits: F.when(plain, F.translate(S, PUNCTUATION, "")).otherwise(digits_of(S)),
                body: F.when(
                    ~plain,
                    F.regexp_extract(
                        F.regexp_replace(F.left(S, F.lit(MAX_INPUT)), EXTENSION, ""), r"(?s)([+0-9].*)$", 1
                    ),
                ),
            },
            {
                number: F.when(BODY.isNull(), DIGITS)
                .when(BODY.rlike("(?:[A-Za-z][^A-Za-z]*){3}"), keyed)
                .otherwise(digits_of(BODY))
            },
            {
                # With a plus sign or the international dialling prefix the
                # country code follows; otherwise the number is national.
                intl: F.when(has_plus, NUMBER).when(
                    F.startswith(NUMBER, F.lit("011")) & (F.substring(NUMBER, 4, 1) != "0"),
                    F.substring(NUMBER, 4, MAX_INPUT),
                )
            },
            {
                nat: F.when(INTL.isNull(), NUMBER).when(
                    F.startswith(INTL, F.lit(code)), F.substring(INTL, 2, MAX_INPUT)
                )
            },
            {
                found: F.when(size(S) > MAX_INPUT, F.lit(None))
                .when(NAT.isNotNull(), F.when(size(home).isin(7, 10), F.concat(F.lit("+" + code), home)))
                .when(INTL.rlike("^[1-9][0-9]{6,14}$") & INTL.rlike(CALLING_CODE), F.concat(F.lit("+"), INTL))
            },
            {
                out: F.when(
                    (S != "") & ~DIGITS.isin(*vocab.JUNK_PHONES) & ~single_digit,
                    F.coalesce(FOUND, F.when(national, F.concat(F.lit("+" + code), DIGITS))),
                ),
                f"{out}_flag": F.when(S.isNull() | (S == ""), F.lit(MISSING))
                .when(DIGITS.isin(*vocab.JUNK_PHONES) | single_digit, F.lit(JUNK))
                .when(FOUND.isNotNull(), F.lit(None))
                .when(national, F.lit(UNVERIFIED))
                .otherwise(F.lit(UNPARSEABLE)),
            },
        ]
    )
