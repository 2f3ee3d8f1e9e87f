"""Names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contactlake import vocab
from contactlake.functions import text
from contactlake.functions.layers import Recipe


def name_recipe(raw: Column, out: str) -> Recipe:
    """Clean a name into column ``out`` (NULL for blank and junk names)."""
    plain, whole, tidy, kept = (f"_{out}_{step}" for step in ("plain", "whole", "tidy", "kept"))
    KEPT, TIDY = F.col(kept), F.col(tidy)
    return Recipe(
        prepare={
            plain: F.when(text.is_ascii(raw), raw).otherwise(
                F.regexp_replace(raw, text.EMOJI_RUN, "")
            )
        },
        compose={whole: text.compose(F.col(plain), compat=True)},
        layers=[
            {tidy: text.strip(F.col(whole))},
            {kept: F.when((TIDY != "") & ~F.lower(TIDY).isin(*vocab.JUNK_NAMES), TIDY)},
            {out: F.when(text.one_case(KEPT), text.title_case(KEPT)).otherwise(KEPT)},
        ],
    )


def spaced(name: Column) -> Column:
    """The name with every white space run as one blank."""
    return F.regexp_replace(name, text.WHITE_SPACE_RUN, " ")


def first_word(spaced_name: Column) -> Column:
    return F.substring_index(spaced_name, " ", 1)


def other_words(spaced_name: Column) -> Column:
    """Everything after the first word; NULL when there is nothing."""
    blank = F.position(F.lit(" "), spaced_name)
    return F.when(blank > 0, F.substring(spaced_name, blank + F.lit(1), F.char_length(spaced_name)))
