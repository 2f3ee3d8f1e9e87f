"""A contact feed derived from ``orders`` (see FIXTURES.md section 3).

Every column is integer arithmetic on ``o_orderkey`` and literals, so the same
feed can be written down in SQL (``workload.feed_sql``). Each row is rendered
as the raw line its source would deliver and parsed back by the readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake import vocab
from contactlake.operators import records
from contactlake.session import configure

FIRST = (
    "Ilse", "Marlo", "Quentin", "Priya", "Tomas", "Wren", "Adaeze", "Bjorn", "Chiara", "Dmitri", "Esme", "Farid",
    "Greta", "Hakon", "Imani", "Jorge", "Keiko", "Leif", "Mirela", "Nadia", "Osei", "Petra", "Rafael", "Sanna",
)
LAST = (
    "Abara", "Bergstrom", "Castellanos", "Dufour", "Eriksen", "Fontaine", "Gallagher", "Hoffmann", "Ishikawa",
    "Jankowski", "Kowalczyk", "Lindqvist", "Mbeki", "Novak", "Okonkwo", "Pereira", "Quintana", "Rosenthal", "Silva",
    "Takahashi",
)
SYMBOLS = ("🌱", "🚀", "☀️", "🎈")
DOMAINS = ("gmail.com", "harborline.org", "icloud.com", "vexcorp.net", "studio-nine.co", "tidewater.io", "aol.com")
CONSENT = ("YES", "decline", "opted in", "0", "Agree", "", "1", "nope", "ok", "No thanks", "later")
CAMPAIGNS = {
    "facebook": ("44100770001", "44100770002", "44100770003", "44100770004"),
    "instagram": ("reel-autumn", "story-launch", "carousel-b", "bio-link"),
    "google_form": ("Newspaper", "Neighbour", "Podcast", "Trade fair"),
    "landing_page": ("spring-open-day", "trial-30", "webinar-07", "whitepaper"),
}
CSV_HEADERS = {
    "instagram": ["Full Name", "E-mail", "Phone #", "Campaign", "Date Submitted", "Consent?"],
    "google_form": [
        "Timestamp",
        "What's your name?",
        "Best number to reach you",
        "Your email address",
        "How did you hear about us?",
        "Do you agree to be contacted?",
    ],
}
INGEST_TS = "2026-08-01 00:00:00"
#: rows of the feed that are worth a task of their own, and tasks per core beyond which they grow instead
ROWS_PER_TASK, TASKS_PER_CORE = 10_000, 3


def ingest_ts() -> Column:
    return F.lit(INGEST_TS).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a few narrow columns in the order of a key, in as many tasks as serve the cores.

    A scan has no more tasks with rows than its file has row groups, and what
    follows here costs far more than the scan.
    """
    tasks = min(-(-rows.count() // ROWS_PER_TASK), TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(max(1, tasks), key).sortWithinPartitions(key)


def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw field values of every row, before rendering."""
    seq = F.col("seq")
    orders = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_orderdate"), "seq")
    # persons come alone, in twos and in threes: the last rows of every nine repeat an earlier one
    place = seq % 9
    base = orders.select(
        "seq",
        _pick(vocab.SOURCES, seq % 4).alias("source"),
        (seq - F.when(place >= 7, place - 6).when(place == 4, 1).otherwise(0)).alias("p"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, seq * 7 % 86400)").cast("timestamp").alias("at"),
    )
    p = F.col("p")
    people = base.withColumns(
        {
            "first": _pick(FIRST, p % 24),
            "last": _pick(LAST, ((p - p % 24) / 24) % 20),
            "d1": (F.lit(212) + (p * 3) % 700).cast("string"),
            "d2": (F.lit(201) + (p * 11) % 780).cast("string"),
            "d3": F.lpad(((p * 53) % 10000).cast("string"), 4, "0"),
        }
    )
    full = F.concat_ws(" ", "first", "last")
    n, e, ph = (seq * 29) % 151, (seq * 41) % 113, (seq * 17) % 59
    name = (
        F.when(n < 4, F.lit("N/A"))
        .when(n < 7, F.lit("none"))
        .when(n < 9, F.lit(" "))
        .when(n < 21, F.lower(full))
        .when(n < 31, F.upper(full))
        .when(n < 38, F.concat(_pick(SYMBOLS, seq % 4), F.lit(" "), full))
        .when(n < 42, F.concat(full, F.lit("  ")))
        .otherwise(full)
    )
    local = F.concat(F.lower("last"), F.lit("."), F.lower(F.substring("first", 1, 1)), p.cast("string"))
    whole = F.concat(local, F.lit("@"), _pick(DOMAINS, p % 7))
    email = (
        F.when(e == 0, F.lit("info@example.net"))
        .when(e == 1, F.lit("test@harborline.org"))
        .when(e == 2, F.lit("not an address"))
        .when(e <= 6, F.concat(local, F.lit("@yaho.com")))
        .when(e <= 8, F.concat(local, F.lit("@outlok.com")))
        .when(e == 9, F.lit(" "))
        .when(e <= 16, F.upper(whole))
        .otherwise(whole)
    )
    d1, d2, d3 = F.col("d1"), F.col("d2"), F.col("d3")
    styles = (
        F.concat_ws(" ", d1, d2, d3),
        F.concat(F.lit("+1 "), F.concat_ws(".", d1, d2, d3)),
        F.concat_ws("/", d1, d2, d3),
        F.concat(F.lit("1"), d1, d2, d3),
        F.concat(F.lit("("), d1, F.lit(")"), d2, F.lit("."), d3),
    )
    phone = F.when(ph == 0, F.lit("555-555-5555")).when(ph == 1, F.lit("unknown")).when(ph == 2, F.lit("   "))
    for i, style in enumerate(styles):
        phone = phone.when(seq % 5 == i, style)
    # two shapes of date for each source
    shapes = {
        "facebook": (F.unix_timestamp("at").cast("string"), F.date_format("at", "yyyy-MM-dd HH:mm:ss")),
        "instagram": (F.date_format("at", "yyyy.MM.dd HH:mm"), F.date_format("at", "MMMM d yyyy")),
        "google_form": (F.date_format("at", "MM-dd-yyyy HH:mm:ss"), F.date_format("at", "dd MMM yyyy hh:mm a")),
        "landing_page": (F.date_format("at", "yyyyMMdd'T'HHmmss'Z'"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    }
    date = F.coalesce(
        *[F.when(F.col("source") == s, F.when(seq % 6 < 3, a).otherwise(b)) for s, (a, b) in shapes.items()]
    )
    campaign = F.coalesce(
        *[F.when(F.col("source") == s, _pick(c, (seq * 3) % 4)) for s, c in CAMPAIGNS.items()]
    )
    k = (seq * 31) % 67
    on_facebook, on_landing = F.col("source") == "facebook", F.col("source") == "landing_page"

    def dropped(which: int) -> Column:
        return on_facebook & (k < 9) & (k % 3 == which)

    return people.select(
        "seq",
        "source",
        "first",
        "last",
        F.when(~dropped(0), name).alias("name_raw"),
        F.when(~dropped(1), email).alias("email_raw"),
        F.when(~dropped(2) & ~(on_landing & ((seq * 37) % 19 == 0)), phone).alias("phone_raw"),
        date.alias("date_raw"),
        F.when(on_landing, F.when(seq % 9 < 5, "true").otherwise("false"))
        .when(~on_facebook, _pick(CONSENT, seq % 11))
        .alias("consent_raw"),
        campaign.alias("campaign_raw"),
    )


def _json_pair(key: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{key}":"'), value, F.lit('"'))


def _webhook_value(name_key: str | Column, phone_key: str | Column, campaign: Column) -> Column:
    def item(key: str | Column, column: str) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        return F.concat(
            F.lit('{"name":"'), key, F.lit('","values":["'), F.col(column), F.lit('"]}')
        )

    items = F.concat_ws(",", item(name_key, "name_raw"), item("email", "email_raw"), item(phone_key, "phone_raw"))
    return F.concat(
        F.lit('{"leadgen_id":"'), F.col("seq").cast("string"), F.lit('",'),
        _json_pair("campaign_id", campaign), F.lit(","),
        _json_pair("created_time", F.col("date_raw")),
        F.lit(',"field_data":['), items, F.lit("]}"),
    )


def _entry(*values: Column) -> Column:
    changes = F.concat_ws(",", *[F.concat(F.lit('{"field":"leadgen","value":'), v, F.lit("}")) for v in values])
    return F.concat(
        F.lit('{"id":"'), F.col("seq").cast("string"), F.lit('","time":'), F.col("seq").cast("string"),
        F.lit(',"changes":['), changes, F.lit("]}"),
    )


def _payload(*entries: Column) -> Column:
    return F.concat(F.lit('{"entry":['), F.concat_ws(",", *entries), F.lit('],"object":"page"}'))


def webhook_line(drifted: Column | None = None) -> Column:
    def key(name: str) -> str | Column:
        if drifted is None:
            return name
        return F.when(drifted, F.lit(vocab.DRIFT_RENAMES[name])).otherwise(F.lit(name))

    return _payload(
        _entry(_webhook_value(key("full_name"), key("phone_number"), F.col("campaign_raw")))
    )


def webhook_line_of_three() -> Column:
    """Two entries with three changes, told apart by their campaign."""

    def value(suffix: str) -> Column:
        return _webhook_value("full_name", "phone_number", F.concat("campaign_raw", F.lit(suffix)))

    return _payload(_entry(value("-a"), value("-b")), _entry(value("-c")))


def landing_line() -> Column:
    pairs = F.concat_ws(
        ",",
        _json_pair("fname", F.col("first")),
        _json_pair("lname", F.col("last")),
        _json_pair("email_addr", F.col("email_raw")),
        _json_pair("utm_campaign", F.col("campaign_raw")),
        F.lit('"utm_source":"google"'),
        F.concat(F.lit('"opt_in":'), F.col("consent_raw")),
        _json_pair("submitted_at", F.col("date_raw")),
        _json_pair("lead_id", F.col("seq").cast("string")),
        _json_pair("mobile", F.col("phone_raw")),
    )
    return F.concat(F.lit("{"), pairs, F.lit("}"))


def csv_lines() -> dict[str, Column]:
    quoted = F.concat(F.lit('"'), F.col("name_raw"), F.lit('"'))
    return {
        "instagram": F.concat_ws(
            ",", quoted, "email_raw", "phone_raw", "campaign_raw", "date_raw", "consent_raw"
        ),
        "google_form": F.concat_ws(
            ",", "date_raw", quoted, "phone_raw", "email_raw", "campaign_raw", "consent_raw"
        ),
    }


def feed_lines(spark: SparkSession, sf_dir: str, drift: bool = False) -> DataFrame:
    """``(source, seq, raw_line)`` of all four sources.

    With ``drift`` the webhook fields are renamed in the second half.
    """
    raw = raw_columns(spark, sf_dir)
    drifted = None
    if drift:
        half = table(spark, sf_dir, "orders").count() // 2
        drifted = F.col("seq") >= half
    lines = {
        "facebook": webhook_line(drifted),
        **csv_lines(),
        "landing_page": landing_line(),
    }
    line = F.coalesce(*[F.when(F.col("source") == s, c) for s, c in lines.items()])
    return raw.select("source", "seq", line.alias("raw_line"))


def parse_feed(lines: DataFrame) -> DataFrame:
    """``(source, seq, raw_line, raw_payload, rec)`` in one pass over the lines, and what else they bring."""
    is_csv = F.col("source").isin(*CSV_HEADERS)
    json_only = lines.withColumn("_json", F.when(~is_csv, F.col("raw_line")))
    parsed = records.with_record(json_only, "_json")
    rec = F.col("rec")
    for source, header in CSV_HEADERS.items():
        rec = F.when(
            F.col("source") == source, records.csv_record(F.col("raw_line"), header)
        ).otherwise(rec)
    return parsed.select(
        "source",
        "seq",
        "raw_line",
        F.when(F.col("source") == "landing_page", F.col("raw_line")).alias("raw_payload"),
        rec.alias("rec"),
        *[c for c in lines.columns if c not in ("source", "seq", "raw_line")],
    )


def feed(spark: SparkSession, sf_dir: str, drift: bool = False) -> DataFrame:
    return parse_feed(feed_lines(spark, sf_dir, drift))
