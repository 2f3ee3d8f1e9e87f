"""Order-insensitive name similarity, 0 to 100.

Tokens are sorted and joined, and the two texts compared by the length of
their longest common subsequence: ``200 * LCS / (len + len)``. A substitution
therefore costs two edits, which ``levenshtein`` does not offer. The LCS runs
bit-parallel on one BIGINT, or on several where both texts are longer than 62
characters.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contactlake import vocab
from contactlake.functions import text

WORD_BITS = 62


def sorted_tokens(name: Column) -> Column:
    """Words in order, joined by one blank."""
    return F.array_join(F.sort_array(text.words(text.strip(name))), " ")


def _characters(c: Column) -> Column:
    return F.array_remove(F.split(c, ""), "")


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; an expression named in a
    lambda would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _lcs_bits(a: Column, b: Column) -> Column:
    """LCS length for ``len(a) <= 62``: zero bits mark matched places of a."""
    parts = F.struct(
        _characters(a).alias("a"),
        _characters(b).alias("b"),
        (_bit(F.char_length(a)) - F.lit(1)).alias("full"),
    )

    def scan(p: Column) -> Column:
        def hits(ch: Column) -> Column:
            marked = F.transform(
                p["a"], lambda x, i: F.when(x == ch, _bit(i)).otherwise(F.lit(0).cast("bigint"))
            )
            return F.aggregate(marked, F.lit(0).cast("bigint"), lambda acc, bit: acc.bitwiseOR(bit))

        def step(state: Column, ch: Column) -> Column:
            return bound(
                state.bitwiseAND(hits(ch)),
                lambda u: (state + u).bitwiseOR(state - u).bitwiseAND(p["full"]),
            )

        state = F.aggregate(p["b"], p["full"], step)
        return F.size(p["a"]) - F.bit_count(state)

    return bound(parts, scan)


def _lcs_words(a: Column, b: Column) -> Column:
    """LCS length for texts of any size: the same scan over several words, with a carry between them."""
    starts = F.sequence(F.lit(0), F.floor((F.char_length(a) - 1) / WORD_BITS).cast("int"))
    none = F.array().cast("array<bigint>")

    def scan(p: Column) -> Column:
        def marked(word: Column, ch: Column) -> Column:
            bits = F.transform(word, lambda x, i: F.when(x == ch, _bit(i)).otherwise(F.lit(0).cast("bigint")))
            return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, bit: acc.bitwiseOR(bit))

        return bound(
            F.transform(starts, lambda j: F.slice(p["a"], j * WORD_BITS + 1, WORD_BITS)),
            lambda words: bound(
                F.struct(
                    # one pass over the text for each different character of it
                    F.map_from_entries(
                        F.transform(
                            F.array_distinct(p["a"]),
                            lambda ch: F.struct(ch, F.transform(words, lambda w: marked(w, ch))),
                        )
                    ).alias("hits"),
                    F.transform(words, lambda w: _bit(F.size(w)) - F.lit(1)).alias("full"),
                ),
                lambda t: F.size(p["a"]) - ones(F.aggregate(p["b"], t["full"], lambda s, ch: step(t, s, ch))).cast("int"),
            ),
        )

    def ones(state: Column) -> Column:
        return F.aggregate(state, F.lit(0).cast("bigint"), lambda n, word: n + F.bit_count(word))

    def step(t: Column, state: Column, ch: Column) -> Column:
        def word(acc: Column, x: Column) -> Column:
            total = x["s"] + x["s"].bitwiseAND(x["h"]) + acc["carry"]
            rest = x["s"] - x["s"].bitwiseAND(x["h"])
            return F.struct(
                F.call_function("shiftright", total, F.lit(WORD_BITS)).alias("carry"),
                F.array_append(acc["out"], total.bitwiseOR(rest).bitwiseAND(x["full"])).alias("out"),
            )

        def advance(hits: Column) -> Column:
            pairs = F.zip_with(state, hits, lambda s, h: F.struct(s.alias("s"), h.alias("h")))
            zipped = F.zip_with(
                pairs, t["full"], lambda x, full: F.struct(x["s"].alias("s"), x["h"].alias("h"), full.alias("full"))
            )
            start = F.struct(F.lit(0).cast("bigint").alias("carry"), none.alias("out"))
            return F.aggregate(zipped, start, word, lambda acc: acc["out"])

        return bound(
            F.try_element_at(t["hits"], ch), lambda hits: F.when(hits.isNull(), state).otherwise(advance(hits))
        )

    return bound(F.struct(_characters(a).alias("a"), _characters(b).alias("b")), scan)


def lcs_length(a: Column, b: Column) -> Column:
    la, lb = F.char_length(a), F.char_length(b)
    return (
        F.when(F.least(la, lb) == 0, F.lit(0))
        .when(la <= WORD_BITS, _lcs_bits(a, b))
        .when(lb <= WORD_BITS, _lcs_bits(b, a))
        .otherwise(_lcs_words(a, b))
    )


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts whose tokens are already sorted."""
    total = F.char_length(a) + F.char_length(b)
    return (
        F.when(a == b, F.lit(100.0))
        .otherwise(F.lit(200.0) * lcs_length(a, b) / total)
        .cast("double")
    )


def names_match(a: Column, b: Column, minimum: float = vocab.NAME_SIMILARITY_MIN) -> Column:
    """D4 on sorted-token names: blank matches anything, else similar enough.

    Equal names and length pairs that cannot reach the minimum are decided
    without computing the similarity.
    """
    la, lb = F.char_length(a), F.char_length(b)
    reachable = F.lit(200.0) * F.least(la, lb) / (la + lb)
    return (
        F.when((a == "") | (b == "") | (a == b), F.lit(True))
        .when(reachable < minimum, F.lit(False))
        .otherwise(F.lit(200.0) * lcs_length(a, b) / (la + lb) >= minimum)
    )
