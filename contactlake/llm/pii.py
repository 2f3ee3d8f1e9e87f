"""Personal data: strict patterns, and weakly supervised spans beside them.

Strict patterns always count. Wider patterns propose further candidates, on
which four labelers vote or abstain: a regex on the candidate, a gazetteer of
cue words before it, its direct surroundings, and its shape. Expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each pattern is personal data; a logistic classifier
over a candidate's features is then trained on these likelihoods and decides.
Texts are only touched by column expressions; the driver sees a table of vote
and feature patterns whose size has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from contactlake.llm.common import fresh

#: fixed values: the strict patterns, in the order that breaks ties. A
#: lookbehind, \\G and possessive loops keep the matches of the plain forms but
#: scan long runs once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret")

#: wider patterns: number groups, spelled-out addresses, long mixed strings
NUMBER = r"(?<![0-9A-Za-z+.@-])\(?[0-9][0-9 ().-]{5,24}[0-9](?![0-9A-Za-z@-])"
SPELLED = (
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63})+"
)
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"

#: gazetteers of the words that stand before a candidate
CUES = ("phone", "tel", "telephone", "call", "mobile", "fax", "contact", "email", "mail", "write", "card", "visa",
        "account", "ssn", "token", "key", "secret", "password", "passwd", "apikey", "auth", "bearer")
PLAIN_CUES = ("page", "figure", "table", "chapter", "version", "isbn", "line", "order", "item", "total", "year", "about")

BEFORE, AFTER = 24, 8
LABELERS = ("v_regex", "v_words", "v_around", "v_shape")
FEATURES = ("kind", "size", *LABELERS)
#: spans placed in one step; the steps are summed up behind each other
BLOCK = 64
BLOT = "\ufffd"
ROUNDS = 50
STEPS = 400

_PLACED = "array<struct<start:int,end:int,content:string,before:string,after:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, guard: Column) -> Column:
    """All matches with their places in code points, leftmost first; none where the guard fails."""
    advance = lambda x: x["skip"] + x["size"]

    def whole(f: Column) -> Column:
        return F.transform(
            f["found"],
            lambda m, i: F.struct(
                F.length(F.get(f["parts"], i)).alias("skip"), F.length(m).alias("size"), m.alias("content"),
                F.right(F.get(f["parts"], i), F.lit(BEFORE)).alias("before"),
                F.left(F.get(f["parts"], i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    def blocks(z: Column) -> Column:
        last = F.floor((F.size(z) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(z, b * BLOCK + 1, BLOCK))

    def offsets(b: Column) -> Column:
        sums = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + advance(y)))
        none = F.array().cast("array<int>")
        return F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def place(block: Column, offset: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["skip"]
            span = F.struct(
                start.alias("start"), (start + x["size"]).alias("end"), x["content"].alias("content"),
                x["before"].alias("before"), x["after"].alias("after"),
            )
            return F.struct((a["at"] + advance(x)).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(
            block, F.struct(offset.alias("at"), F.array().cast(_PLACED).alias("out")), step, lambda a: a["out"]
        )

    def spans(f: Column) -> Column:
        return let(whole(f), lambda z: let(blocks(z), lambda b: F.flatten(F.zip_with(b, offsets(b), place))))

    cut = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("parts")
    )
    none = F.array().cast(_PLACED)
    return F.when(guard, let(cut, lambda f: F.when(F.size(f["found"]) > 0, spans(f)).otherwise(none))).otherwise(none)


def _digits(content: Column) -> Column:
    return F.regexp_replace(content, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 1 to 19 digits has a valid check digit."""

    def value(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def strict_spans(text: Column) -> Column:
    """The spans of the strict patterns, failing matches dropped, as ``(start, rank, end, kind)`` in order."""
    digits = text.rlike("[0-9]")
    found = {
        "email": located(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(
            located(text, IP, digits & F.contains(text, F.lit("."))), lambda x: F.forall(F.split(x["content"], r"\."), _byte)
        ),
        "card": F.filter(
            located(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){11}")),
            lambda x: let(
                _digits(x["content"]),
                lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)),
            ),
        ),
        "phone": F.filter(
            located(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["content"])).between(9, 15)
        ),
    }
    return F.sort_array(F.concat(*[F.transform(v, _span(k)) for k, v in found.items()]).cast(_SPANS))


def _span(kind: str) -> Callable[[Column], Column]:
    rank = F.lit(KINDS.index(kind))
    return lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _vote(*cases: tuple[Column, int]) -> Column:
    """The first case that holds; -1 abstains."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(-1)


def _candidate(kind_of: Callable[[Column], Column], regex: Callable[[Column], Column], shape: Callable[[Column], Column]):
    def build(x: Column) -> Column:
        word = F.lower(F.regexp_extract(x["before"], r"([A-Za-z]+)[^A-Za-z]*$", 1))
        around = _vote(
            (x["before"].rlike(r"""[:=#"'(<]\s?$"""), 1), (x["after"].rlike(r"^\s?(?:%|[A-Za-z]{1,2}\b)"), 0)
        )
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), kind_of(x["content"]).alias("kind"),
            F.least(F.floor(F.length(x["content"]) / 5), F.lit(9)).cast("int").alias("size"),
            regex(x["content"]).alias("v_regex"), _vote((word.isin(*CUES), 1), (word.isin(*PLAIN_CUES), 0)).alias("v_words"),
            around.alias("v_around"), shape(x["content"]).alias("v_shape"),
        )

    return build


def _variety(content: Column) -> Column:
    return F.size(F.array_distinct(F.split(content, "")))


def candidates(text: Column) -> Column:
    """What the wider patterns propose: place, kind, size class and the four votes (1, 0 or -1)."""
    digits = text.rlike("[0-9]")
    count = lambda c: F.length(_digits(c))
    number = _candidate(
        lambda c: F.when(count(c).between(12, 19), F.lit("card")).otherwise(F.lit("phone")),
        lambda c: _vote(
            (c.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), 1), (c.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 1),
            (c.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & (count(c) < 12), 0), (c.rlike(r"[.-]{2}|  "), 0),
        ),
        lambda c: _vote((_variety(_digits(c)) <= 2, 0), (count(c).between(9, 16) & (_variety(_digits(c)) >= 5), 1)),
    )
    spelled = _candidate(
        lambda c: F.lit("email"), lambda c: _vote((c.rlike(r"(?i)[\[( ]dot[\]) ]"), 1)),
        lambda c: _vote((F.length(c) < 10, 0), (c.rlike(r"[\[(]at[\])]"), 1)),
    )
    secret = _candidate(
        lambda c: F.lit("secret"), lambda c: _vote((c.rlike("^[0-9a-f]{32,}$"), 1), (~c.rlike("[0-9]"), 0)),
        lambda c: _vote((_variety(c) >= 12, 1), (_variety(c) <= 6, 0)),
    )
    return F.concat(
        F.transform(F.filter(located(text, NUMBER, digits), lambda x: count(x["content"]).between(7, 19)), number),
        F.transform(located(text, SPELLED, F.contains(text, F.lit("dot"))), spelled),
        F.transform(F.filter(located(text, SECRET, digits), lambda x: x["content"].rlike("[A-Za-z]")), secret),
    )


def reliabilities(patterns: Sequence[tuple[tuple[int, ...], float]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation maximisation over (votes, count): the share of personal data, and P(vote | class) per labeler."""
    likely = []
    for votes, _ in patterns:  # begin with the majority of those that vote
        cast = [v for v in votes if v >= 0]
        likely.append((sum(cast) + 0.5) / (len(cast) + 1))
    total = sum(n for _, n in patterns)
    share, tables = 0.5, []
    for _ in range(ROUNDS):
        share = (sum(p * n for p, (_, n) in zip(likely, patterns)) + 1) / (total + 2)
        tables = []
        for j in range(len(patterns[0][0])):
            seen = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(likely, patterns):
                seen[votes[j]][1] += p * n
                seen[votes[j]][0] += (1 - p) * n
            sums = [sum(s[c] for s in seen.values()) for c in (0, 1)]
            tables.append({v: (s[0] / sums[0], s[1] / sums[1]) for v, s in seen.items()})
        likely = [posterior(votes, share, tables) for votes, _ in patterns]
    return share, tables


def posterior(votes: Sequence[int], share: float, tables: Sequence[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[v][1] / t[v][0]) for v, t in zip(votes, tables))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


@dataclass(frozen=True)
class Classifier:
    """A logistic model over the values of FEATURES."""

    bias: float
    weights: dict[tuple[str, object], float]

    def keeps(self, x: Column) -> Column:
        """Whether a candidate counts as personal data."""
        total = F.lit(self.bias)
        for (name, value), weight in sorted(self.weights.items(), key=repr):
            total = total + F.when(x[name] == value, weight).otherwise(0.0)
        return total >= 0


def train(rows: Sequence[Row]) -> Classifier | None:
    """A classifier from rows of FEATURES with ``n``; None without candidates."""
    if not rows:
        return None
    counts: dict[tuple[int, ...], float] = {}
    for r in rows:
        votes = tuple(r[v] for v in LABELERS)
        counts[votes] = counts.get(votes, 0) + r["n"]
    share, tables = reliabilities(sorted(counts.items()))
    examples = sorted(
        ([(f, r[f]) for f in FEATURES], posterior([r[v] for v in LABELERS], share, tables), r["n"]) for r in rows
    )
    total = sum(n for _, _, n in examples)
    bias, weights = 0.0, {f: 0.0 for fs, _, _ in examples for f in fs}
    for _ in range(STEPS):
        slope_bias, slope = 0.0, {f: 1e-3 * w for f, w in weights.items()}
        for fs, p, n in examples:
            odds = max(-30.0, min(30.0, bias + sum(weights[f] for f in fs)))
            error = (1 / (1 + math.exp(-odds)) - p) * n / total
            slope_bias += error
            for f in fs:
                slope[f] += error
        bias -= slope_bias
        weights = {f: w - slope[f] for f, w in weights.items()}
    return Classifier(bias, weights)


def fit(found: DataFrame, column: str) -> Classifier | None:
    """Train on all candidates of a column; at most 4 kinds * 10 sizes * 3**4 votes reach the driver."""
    each = found.select(F.explode(column).alias("x")).groupBy(*[F.col(f"x.{f}").alias(f) for f in FEATURES])
    return train(each.agg(F.count(F.lit(1)).alias("n")).collect())


def all_spans(strict: Column, proposed: Column, model: Classifier | None) -> Column:
    """The strict spans and the accepted candidates, in order; candidates touch no strict span."""
    if model is None:
        return strict
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int") - 1
    added = F.transform(
        F.filter(proposed, model.keeps),
        lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    return F.sort_array(F.array_distinct(F.concat(strict, added.cast(_SPANS))))


def _replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with spans replaced by ``fill(span, code points not yet replaced)``."""

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(a["at"], s["start"])
        size = F.greatest(s["end"] - start, F.lit(0))
        kept = F.substring(text, a["at"] + 1, start - a["at"])
        return F.struct(
            (start + size).alias("at"), F.concat(a["out"], F.array(F.concat(kept, fill(s, size)))).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(
        spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def masked(text: Column, spans: Column) -> Column:
    """The text with spans blotted out in place: what the wider patterns look at."""
    return _replaced(text, spans, lambda s, size: F.repeat(F.lit(BLOT), size))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; an overlapping span adds its kind behind."""
    name = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    return _replaced(text, spans, lambda s, size: F.when(size > 0, name(s)).otherwise(""))


def described(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``(key, strict, spans)``: the strict spans, and all spans after the classifier.

    Null texts are empty and have no spans; repeated rows and null keys stay;
    an empty table gives an empty result.
    """
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    strict = given.withColumn("strict", strict_spans(F.col("text")))
    rest = strict.select("key", "strict", masked(F.col("text"), F.col("strict")).alias("rest"))
    found = scratch.put("found", rest.select("key", "strict", candidates(F.col("rest")).alias("proposed")))
    model = fit(found, "proposed")
    return found.select(F.col("key").alias(key), "strict", all_spans(F.col("strict"), F.col("proposed"), model).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced by its kind; a null text stays null."""
    content, strict, rest, proposed, spans = (fresh(docs, f"pii_{n}") for n in ("text", "strict", "rest", "proposed", "spans"))
    given = docs.withColumn(content, F.coalesce(F.col(text), F.lit("")))
    strictly = given.withColumn(strict, strict_spans(F.col(content)))
    looked = strictly.withColumn(rest, masked(F.col(content), F.col(strict))).withColumn(proposed, candidates(F.col(rest)))
    model = fit(looked.select(proposed), proposed)
    placed = looked.withColumn(spans, all_spans(F.col(strict), F.col(proposed), model))
    changed = F.when(F.col(text).isNotNull(), redacted(F.col(content), F.col(spans)))
    return placed.withColumn(text, changed).select(*docs.columns)
