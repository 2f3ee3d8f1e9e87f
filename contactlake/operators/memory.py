"""The memory of approved fields and similarity search in it.

A field is described by its name and first sample values. The description's
character n-grams, hashed into counters, stand in for a text embedding and are
stored with the field. Similarity is the cosine of the counters: whole numbers
but for one division, so that every engine ranks alike.

``similar`` answers many queries at once. Its index hashes the signs of random
projections into bands; descriptions that meet a query in some band are ranked
exactly. Queries that find fewer than k that way, or all if ``exact``, go
through the postings of the counters instead, which miss nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contactlake import vocab
from contactlake.functions.similarity import bound
from contactlake.operators.positions import first_per_group
from contactlake.operators.upsert import latest_by_key

#: length of the n-grams, and the counters they are hashed into
GRAM, DIMENSIONS = 3, 256
#: the index: so many bands of so many signs
BANDS, SIGNS = 64, 5
DOC_SAMPLES, QUERY_SAMPLES = 3, 2


def _quoted(samples: Column, n: int) -> Column:
    return F.concat(
        F.lit("["),
        F.array_join(
            F.transform(F.slice(samples, 1, n), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "
        ),
        F.lit("]"),
    )


def field_doc(field: Column, samples: Column) -> Column:
    return F.concat(
        F.lit("source field '"), field, F.lit("' with sample values "), _quoted(samples, DOC_SAMPLES)
    )


def described(field: Column, samples: Column, n: int) -> Column:
    """A field's name and its first samples."""
    return F.array_join(F.concat(F.array(field), F.slice(F.coalesce(samples, F.array().cast("array<string>")), 1, n)), " ")


def field_vector(field: Column, samples: Column) -> Column:
    return text_vector(described(field, samples, DOC_SAMPLES))


def text_vector(text: Column) -> Column:
    """The counters of a description that are not zero, as sorted pairs (dim, n).

    Letters count without case and all digits alike; a description of fewer
    than ``GRAM`` characters has no counters.
    """
    text = F.regexp_replace(F.lower(text), "[0-9]", "0")
    none = F.array().cast("array<struct<dim:int,n:int>>")

    def hashed(text: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.char_length(text) - GRAM + 1),
            lambda i: (F.conv(F.left(F.md5(F.substring(text, i, F.lit(GRAM))), F.lit(8)), 16, 10).cast("bigint") % DIMENSIONS).cast("int"),
        )

    def runs(dims: Column) -> Column:
        # where a counter's run of equal numbers starts, and one place after the last
        starts = F.filter(
            F.sequence(F.lit(0), F.size(dims)),
            lambda i: (i == 0) | (i == F.size(dims)) | ~F.get(dims, i).eqNullSafe(F.get(dims, i - 1)),
        )
        return bound(
            starts,
            lambda s: F.transform(
                F.slice(s, F.lit(1), F.size(s) - 1),
                lambda at, j: F.struct(F.get(dims, at).alias("dim"), (F.get(s, j + 1) - at).alias("n")),
            ),
        )

    counted = bound(text, lambda t: F.when(F.char_length(t) >= GRAM, bound(F.sort_array(hashed(t)), runs)))
    return F.coalesce(counted, none)


def remember_fields(mapping: DataFrame, profile: DataFrame, version: Column) -> DataFrame:
    """M9: memory rows of an approved mapping table; ``ignore`` is left out."""
    samples = profile.select("source", "field", "samples")
    none = F.array().cast("array<string>")
    return (
        mapping.filter(F.col("transform") != "ignore")
        .join(samples, ["source", "field"], "left")
        .select(
            F.concat("source", F.lit("::"), "field").alias("id"),
            "source",
            "field",
            "transform",
            field_doc(F.col("field"), F.coalesce("samples", none)).alias("doc"),
            field_vector(F.col("field"), F.col("samples")).alias("vector"),
            version.alias("version"),
        )
    )


def upsert_memory(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest_by_key(old.unionByName(new), "id", "version")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda total, d: total + d,
    )


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda total, d: total + d,
        )

    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


DISTANCES = {"l2": squared_l2, "cosine": cosine_distance}


def top_k(
    memory: DataFrame,
    query: list[float],
    k: int = vocab.RETRIEVAL_K,
    vector: str = "embedding",
    tie_break: str = "id",
    metric: str = "l2",
) -> DataFrame:
    """The ``k`` nearest rows to one query vector.

    The query is a literal, so this is one scan with a bounded top-k per task
    and no join; a memory with fewer than ``k`` rows gives them all.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    distance = DISTANCES[metric](F.col(vector), literal)
    return memory.withColumn("distance", distance).orderBy("distance", tie_break).limit(k)


def _norm(vector: str) -> Column:
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda total, e: total + e["n"] * e["n"])


def _bands(vector: str) -> Column:
    """One key per band: the signs of ``SIGNS`` random projections of the counters, and the band's number."""

    def sign(plane: Column) -> Column:
        one = F.aggregate(
            vector, F.lit(0).cast("bigint"),
            lambda total, e: total + F.when(F.xxhash64(plane, e["dim"]).bitwiseAND(F.lit(1)) == 1, e["n"]).otherwise(-e["n"]),
        )
        return F.when(one >= 0, F.lit(1)).otherwise(F.lit(0))

    def key(band: Column) -> Column:
        signs = F.sequence(F.lit(0), F.lit(SIGNS - 1))
        return F.aggregate(signs, band, lambda bits, j: bits * 2 + sign(band * SIGNS + j))

    # the leading bits of a key are its band
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)


def _by_postings(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(qkey, ckey, similarity) of all that share a counter."""
    q = queries.select("qkey", F.col("norm").alias("_qn"), F.explode("vector").alias("e")).select("qkey", "_qn", "e.dim", F.col("e.n").alias("_q"))
    c = classes.select("ckey", F.col("norm").alias("_cn"), F.explode("vector").alias("e")).select("ckey", "_cn", "e.dim", F.col("e.n").alias("_c"))
    dots = q.join(c, "dim").groupBy("qkey", "ckey").agg(
        F.sum(F.col("_q").cast("bigint") * F.col("_c")).alias("_dot"), F.max("_qn").alias("_qn"), F.max("_cn").alias("_cn")
    )
    return dots.select("qkey", "ckey", _cosine().alias("similarity"))


def _by_bands(queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(qkey, ckey, similarity) of all that meet in a band."""
    q = queries.select("qkey", F.explode(_bands("vector")).alias("band"))
    c = classes.select("ckey", F.explode(_bands("vector")).alias("band"))
    met = q.join(c, "band").select("qkey", "ckey").distinct()
    both = met.join(queries.select("qkey", F.col("vector").alias("_q"), F.col("norm").alias("_qn")), "qkey").join(
        classes.select("ckey", F.map_from_entries("vector").alias("_c"), F.col("norm").alias("_cn")), "ckey"
    )
    dot = F.aggregate("_q", F.lit(0).cast("bigint"), lambda total, e: total + e["n"] * F.coalesce(F.try_element_at("_c", e["dim"]), F.lit(0)))
    return both.withColumn("_dot", dot).select("qkey", "ckey", _cosine().alias("similarity"))


def _cosine() -> Column:
    return F.col("_dot").cast("double") / F.sqrt((F.col("_qn") * F.col("_cn")).cast("double"))


def _best(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(qkey, rank, id, transform, similarity): the k most similar, ties by id."""
    by_class = Window.partitionBy("qkey").orderBy(F.desc("similarity"), F.col("members")[0]["id"])
    by_id = Window.partitionBy("qkey").orderBy(F.desc("similarity"), "id")
    return (
        found.join(classes.select("ckey", "members"), "ckey")
        .withColumn("_r", F.row_number().over(by_class))
        .filter(F.col("_r") <= k)
        .select("qkey", "similarity", F.explode("members").alias("m"))
        .select("qkey", "similarity", "m.id", "m.transform")
        .withColumn("rank", F.row_number().over(by_id))
        .filter(F.col("rank") <= k)
    )


def similar(
    memory: DataFrame, queries: DataFrame, k: int = vocab.RETRIEVAL_K, exact: bool = False
) -> DataFrame:
    """M10 for many queries at once: the rows of ``queries`` with ``rank, id, transform, similarity``.

    ``queries`` and ``memory`` (with ``id`` and ``transform``) bring their
    ``vector``. Equal vectors are compared once, of equal ones in the memory
    the k least ids count. A query without counters finds nothing.
    """
    key = F.md5(F.to_json("vector"))
    asked = queries.withColumn("qkey", key)
    distinct = asked.groupBy("qkey").agg(F.first("vector").alias("vector")).withColumn("norm", _norm("vector")).filter("norm > 0")
    keyed = memory.select("id", "transform", "vector", key.alias("ckey")).filter(F.size("vector") > 0)
    classes = (
        first_per_group(keyed, ["ckey"], ["id"], k)
        .groupBy("ckey")
        .agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list(F.struct("id", "transform"))).alias("members"))
        .withColumn("norm", _norm("vector"))
    )
    if exact:
        best = _best(_by_postings(distinct, classes), classes, k)
    else:
        near = _best(_by_bands(distinct, classes), classes, k)
        enough = near.filter(F.col("rank") == k).select("qkey")
        lacking = distinct.join(enough, "qkey", "left_anti")
        best = near.join(enough, "qkey", "left_semi").unionByName(_best(_by_postings(lacking, classes), classes, k))
    return asked.join(best, "qkey").drop("qkey")


def similar_fields(
    memory: DataFrame, profile: DataFrame, k: int = vocab.RETRIEVAL_K, keys: tuple[str, ...] = ("source",), exact: bool = False
) -> DataFrame:
    """M10 for every field of the profiles: the approved fields most like it."""
    asked = profile.select(*[F.col(c).alias(f"for_{c}") for c in (*keys, "field")], field_vector(F.col("field"), F.col("samples")).alias("vector"))
    return similar(memory, asked, k, exact).drop("vector")


def similar_to_profile(
    memory: DataFrame, profile: DataFrame, k: int = vocab.RETRIEVAL_K, keys: tuple[str, ...] = ("source",), exact: bool = False
) -> DataFrame:
    """M10 for whole profiles: the approved fields most like a source's fields taken together."""
    line = F.struct("ordinal", described(F.col("field"), F.col("samples"), QUERY_SAMPLES).alias("text"))
    whole = profile.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["text"]), " ")
    asked = whole.select(*[F.col(c).alias(f"for_{c}") for c in keys], text_vector(text).alias("vector"))
    return similar(memory, asked, k, exact).drop("vector")
