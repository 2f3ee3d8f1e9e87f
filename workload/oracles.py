"""The expected result of each query, as DuckDB SQL over the same tables."""

from __future__ import annotations

from contactlake import vocab
from workload import feed as f
from workload.feed_sql import RAW, leads, lines
from workload.queries import BATCH

TS = "'%Y-%m-%d %H:%M:%S'"
INGEST = f"'{f.INGEST_TS}'"
HALF = "(SELECT count(*) // 2 FROM orders)"


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def _raw(body: str) -> str:
    return _with(RAW, body)


def _leads(body: str, more: str = "", drift: bool = False) -> str:
    return _with(leads(drift) + more, body)


# Keys of each record in the order of its text, and the values.
_CELLS = """
cells AS (
  SELECT seq, source, renamed, unnest([
      {{'place': 0, 'field': 'campaign_id', 'value': campaign_raw, 'present': true}},
      {{'place': 1, 'field': 'created_time', 'value': date_raw, 'present': true}},
      {{'place': 2, 'field': CASE WHEN renamed THEN 'applicant_name' ELSE 'full_name' END, 'value': name_raw, 'present': name_raw IS NOT NULL}},
      {{'place': 3, 'field': 'email', 'value': email_raw, 'present': email_raw IS NOT NULL}},
      {{'place': 4, 'field': CASE WHEN renamed THEN 'contact_phone' ELSE 'phone_number' END, 'value': phone_raw, 'present': phone_raw IS NOT NULL}}
    ]) AS c FROM {lines} WHERE source = 'facebook'
  UNION ALL
  SELECT seq, source, renamed, unnest([
      {{'place': 0, 'field': 'Full Name', 'value': name_raw, 'present': true}},
      {{'place': 1, 'field': 'E-mail', 'value': email_raw, 'present': true}},
      {{'place': 2, 'field': 'Phone #', 'value': phone_raw, 'present': true}},
      {{'place': 3, 'field': 'Campaign', 'value': campaign_raw, 'present': true}},
      {{'place': 4, 'field': 'Date Submitted', 'value': date_raw, 'present': true}},
      {{'place': 5, 'field': 'Consent?', 'value': consent_raw, 'present': true}}
    ]) FROM {lines} WHERE source = 'instagram'
  UNION ALL
  SELECT seq, source, renamed, unnest([
      {{'place': 0, 'field': 'Timestamp', 'value': date_raw, 'present': true}},
      {{'place': 1, 'field': 'What''s your name?', 'value': name_raw, 'present': true}},
      {{'place': 2, 'field': 'Best number to reach you', 'value': phone_raw, 'present': true}},
      {{'place': 3, 'field': 'Your email address', 'value': email_raw, 'present': true}},
      {{'place': 4, 'field': 'How did you hear about us?', 'value': campaign_raw, 'present': true}},
      {{'place': 5, 'field': 'Do you agree to be contacted?', 'value': consent_raw, 'present': true}}
    ]) FROM {lines} WHERE source = 'google_form'
  UNION ALL
  SELECT seq, source, renamed, unnest([
      {{'place': 0, 'field': 'fname', 'value': first_raw, 'present': true}},
      {{'place': 1, 'field': 'lname', 'value': last_raw, 'present': true}},
      {{'place': 2, 'field': 'email_addr', 'value': email_raw, 'present': true}},
      {{'place': 3, 'field': 'utm_campaign', 'value': campaign_raw, 'present': true}},
      {{'place': 4, 'field': 'utm_source', 'value': 'google', 'present': true}},
      {{'place': 5, 'field': 'opt_in', 'value': consent_raw, 'present': true}},
      {{'place': 6, 'field': 'submitted_at', 'value': date_raw, 'present': true}},
      {{'place': 7, 'field': 'lead_id', 'value': CAST(seq AS VARCHAR), 'present': true}},
      {{'place': 8, 'field': 'mobile', 'value': phone_raw, 'present': phone_raw IS NOT NULL}}
    ]) FROM {lines} WHERE source = 'landing_page'
)"""

_PLACED = f""",
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) - 1 AS pos FROM lines
),
batched AS (
  SELECT *, pos // {BATCH} AS batch_id, pos % {BATCH} AS batch_pos FROM placed
)"""


def _cells(table: str) -> str:
    return "," + _CELLS.format(lines=table) + ",\npresent AS (SELECT seq, source, c.place AS place, c.field AS field, c.value AS value FROM cells WHERE c.present)"


def _known(active_only: bool, alias: str = "known") -> str:
    rows = [
        "('" + source + "', '" + field.replace("'", "''") + "', '" + transform + "')"
        for source, mapping in vocab.KNOWN_MAPPINGS.items()
        for field, transform in mapping.items()
        if not (active_only and transform == "ignore")
    ]
    return "(VALUES " + ", ".join(rows) + f") AS {alias}(source, field, transform)"


def _profile(cells: str, samples: int = vocab.PROFILE_SAMPLES) -> str:
    """Profile of ``present`` joined with the counts per source."""
    return f"""
SELECT p.source, p.field, any_value(s.n) AS n, count(*) AS present,
       coalesce(array_to_string(list_transform(list_slice(list_sort(
         list({{'at': p.seq, 'v': p.value}}) FILTER (WHERE p.value <> '')
       ), 1, {samples}), lambda x: x.v), '|'), '') AS samples
FROM present p JOIN sizes s USING (source)
GROUP BY p.source, p.field"""


_SIZES = """,
sizes AS (SELECT source, count(*) AS n FROM lines GROUP BY source)"""

_MISSING = """,
totals AS (SELECT source, batch_id, count(*) AS n FROM batched GROUP BY ALL),
hits AS (
  SELECT b.source, b.batch_id, p.field, count(*) AS hits
  FROM present p JOIN batched b USING (source, seq) GROUP BY ALL
),
missing AS (
  SELECT t.source, t.batch_id, t.n, k.field, t.n - coalesce(h.hits, 0) AS missing
  FROM totals t JOIN """ + _known(True, "k") + """ USING (source)
  LEFT JOIN hits h ON h.source = t.source AND h.batch_id = t.batch_id AND h.field = k.field
),
decision AS (
  SELECT source, batch_id, n, CAST(0 AS BIGINT) AS failed,
         coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE missing / n > 0.8), '') AS dead_fields,
         count(*) FILTER (WHERE missing / n > 0.8) > 0 AS drifted
  FROM missing GROUP BY source, batch_id, n
)"""

_UNMAPPED = """,
unmapped AS (
  SELECT DISTINCT b.source, b.batch_id, p.field
  FROM present p JOIN batched b USING (source, seq)
  WHERE (p.source, p.field) NOT IN (SELECT (source, field) FROM """ + _known(False) + """)
)"""

_DRIFT = lines(True) + _PLACED + _cells("lines") + _MISSING + _UNMAPPED

_BROKEN = lines() + """,
broken AS (
  SELECT seq, source,
    CASE WHEN source = 'landing_page' AND seq % 97 < 10 THEN 'unreadable_record'
         WHEN source = 'landing_page' AND seq % 89 < 6 THEN 'created_at_range' ELSE '' END AS violations
  FROM lines
)"""

_MAPPING_LOG = """
versions AS (
  SELECT 'form-' || o_custkey AS source, o_orderkey AS version,
         CASE WHEN o_orderkey % 7 = 0 THEN 'invalidated' ELSE 'approved' END AS state
  FROM orders
),
entries AS (
  SELECT source, version, CAST(1 AS BIGINT) AS ordinal, 'name' AS field, 'split_full_name' AS transform
  FROM versions WHERE state = 'approved'
  UNION ALL
  SELECT source, version, 2, 'contact' || (version % 5), CASE WHEN version % 2 = 0 THEN 'email' ELSE 'phone' END
  FROM versions WHERE state = 'approved'
  UNION ALL
  SELECT source, version, 3, 'note', 'ignore' FROM versions WHERE state = 'approved'
)"""

_PROPOSALS = """
profile AS (
  SELECT 'form-' || c_custkey AS source, unnest([1, 2, 3, 4]) AS ordinal, unnest(['name', 'mail', 'tel', 'note']) AS field
  FROM customer
),
proposal AS (
  SELECT 'form-' || c_custkey AS source, unnest([1, 2, 3]) AS ordinal,
         unnest([CASE WHEN c_custkey % 5 = 1 THEN 'nom' ELSE 'name' END, 'mail', 'tel']) AS field,
         unnest([CASE WHEN c_custkey % 7 = 2 THEN 'ignore' ELSE 'split_full_name' END,
                 CASE WHEN c_custkey % 3 = 0 THEN 'ignore' ELSE 'email' END,
                 CASE WHEN c_custkey % 4 = 0 THEN 'ignore' ELSE 'phone' END]) AS transform
  FROM customer WHERE c_custkey % 11 <> 0
),
verdicts AS (
  SELECT 'form-' || c_custkey AS source,
    CASE WHEN c_custkey % 11 = 0 THEN 'the mapping is empty'
         WHEN c_custkey % 5 = 1 THEN 'mapped field does not exist in the source: nom'
         WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN 'the mapping identifies neither an email nor a phone field'
         WHEN c_custkey % 7 = 2 THEN 'the mapping identifies no name field' END AS reason
  FROM customer
)"""

_RENAMED_MAPPING = {
    vocab.DRIFT_RENAMES.get(field, field): transform
    for field, transform in vocab.KNOWN_MAPPINGS["facebook"].items()
}


def _golden(mappings: dict[str, dict[str, str]]) -> str:
    rows = [
        "('" + source + "', '" + field.replace("'", "''") + "', '" + transform + "')"
        for source, mapping in mappings.items()
        for field, transform in mapping.items()
    ]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(source, field, transform)"


def _sample_text(samples: int) -> str:
    """A field's name and its first values in the order of the records."""
    return f"""array_to_string([any_value(field)] || list_transform(list_slice(list_sort(
      list({{'at': seq, 'v': value}}) FILTER (WHERE value <> '')), 1, {samples}), lambda x: x.v), ' ')"""


# Descriptions of the fields of every source and half (asked) and of the approved fields (kept).
_DESCRIBED = (
    lines(True) + _cells("lines") + f""",
halves AS (SELECT *, seq >= {HALF} AS late FROM present),
based AS (
  SELECT source, seq, value, CASE field WHEN 'applicant_name' THEN 'full_name' WHEN 'contact_phone' THEN 'phone_number' ELSE field END AS field
  FROM present
),
kept AS (
  SELECT b.source || '::' || b.field AS id, any_value(k.transform) AS transform, {_sample_text(3).replace("any_value(field)", "b.field")} AS text
  FROM based b JOIN """ + _known(True, "k") + """ ON k.source = b.source AND k.field = b.field GROUP BY b.source, b.field
)"""
)

# Character trigrams hashed into 256 counters, and the cosine of the counters.
_NEAREST = """,
counted AS (
  SELECT side, id, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 256 AS dim, count(*) AS n FROM (
    SELECT side, id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram
    FROM (SELECT side, id, regexp_replace(lower(text), '[0-9]', '0', 'g') AS t FROM (
      SELECT 0 AS side, id, text FROM asked UNION ALL SELECT 1, id, text FROM kept))) GROUP BY ALL
),
norms AS (SELECT side, id, sum(n * n)::BIGINT AS norm FROM counted GROUP BY ALL),
dots AS (
  SELECT q.id AS qid, c.id, sum(q.n * c.n)::BIGINT AS dot FROM counted q JOIN counted c USING (dim)
  WHERE q.side = 0 AND c.side = 1 GROUP BY ALL
),
nearest AS (
  SELECT qid, id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (
    SELECT qid, d.id, dot::DOUBLE / sqrt((a.norm * b.norm)::DOUBLE) AS similarity FROM dots d
    JOIN norms a ON a.side = 0 AND a.id = qid JOIN norms b ON b.side = 1 AND b.id = d.id) QUALIFY rank <= 6
)"""

_DOC = """CASE WHEN e.field = 'name'
       THEN 'source field ''name'' with sample values [''' || c.c_name || ''', ''' || c.c_mktsegment || ''']'
       ELSE 'source field ''' || e.field || ''' with sample values []' END"""

# token-sorted similarity: bit-parallel LCS over a list of characters
_LCS = """(length(a) - bit_count(list_reduce(
      list_transform(string_split(b, ''), lambda ch: list_sum(list_transform(range(length(a)),
         lambda i: CASE WHEN substr(a, CAST(i + 1 AS BIGINT), 1) = ch THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END))::BIGINT),
      lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((CAST(1 AS BIGINT) << length(a)) - 1),
      (CAST(1 AS BIGINT) << length(a)) - 1)))"""

_PAIRS = """,
cands AS (
  SELECT lead_id, coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS name,
         phone_e164, email, source, CAST(quality_score AS BIGINT) AS quality_score
  FROM leads
),
keyed AS (
  SELECT 'phone_e164' AS block, phone_e164 AS k, lead_id, name FROM cands WHERE phone_e164 <> ''
  UNION ALL
  SELECT 'email', email, lead_id, name FROM cands WHERE email <> ''
),
firsts AS (
  SELECT block, k, min(lead_id) AS first_id, arg_min(name, lead_id) AS first_name FROM keyed GROUP BY ALL
),
pairs AS (
  SELECT block, first_id, first_name, lead_id, name FROM keyed JOIN firsts USING (block, k)
  WHERE lead_id <> first_id
),
sorted AS (
  SELECT *, array_to_string(list_sort(string_split(trim(first_name), ' ')), ' ') AS a,
         array_to_string(list_sort(string_split(trim(name), ' ')), ' ') AS b
  FROM pairs
)"""

_MATCHED = _PAIRS + f""",
ratios AS (
  SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE 200.0 * {_LCS} / (length(a) + length(b)) END AS similarity
  FROM (SELECT DISTINCT a, b FROM sorted WHERE a <> '' AND b <> '')
),
matched AS (
  SELECT block, first_id, lead_id FROM sorted LEFT JOIN ratios USING (a, b)
  WHERE a = '' OR b = '' OR similarity >= 55
)"""

_GROUPS = _MATCHED + """,
both_ways AS (
  SELECT DISTINCT first_id AS u, lead_id AS v FROM matched
  UNION SELECT DISTINCT lead_id, first_id FROM matched
),
reach AS (
  SELECT u AS node, u AS seen FROM both_ways
  UNION
  SELECT r.node, e.v FROM reach r JOIN both_ways e ON e.u = r.seen
),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
members AS (
  SELECT c.component, c.node, l.source, l.quality_score
  FROM components c JOIN cands l ON l.lead_id = c.node
),
groups AS (
  SELECT component, arg_min(node, (-quality_score, node)) AS survivor_id, count(*) AS members,
         count(DISTINCT source) > 1 AS cross_source
  FROM members GROUP BY component
),
resolved AS (
  SELECT l.*, CASE WHEN c.node IS NOT NULL AND c.node NOT IN (SELECT survivor_id FROM groups)
                   THEN 'duplicate' ELSE l.status END AS final_status
  FROM leads l LEFT JOIN components c ON c.node = l.lead_id
)"""


def _resolved(body: str) -> str:
    return _leads(body, _GROUPS)


ADDRESS = (
    "^[a-z0-9!#$%&''*+/=?^_`{|}~-]+([.][a-z0-9!#$%&''*+/=?^_`{|}~-]+)*@"
    "([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+([a-z0-9][a-z0-9-]*)?[a-z]$"
)

ORACLES: dict[str, str] = {
    "s1_scan_json_lines": _raw(
        "SELECT seq, first_raw AS fname, email_raw AS email_addr, phone_raw AS mobile, consent_raw AS opt_in, "
        "CAST(8 + (phone_raw IS NOT NULL)::INT AS BIGINT) AS n_keys FROM raw WHERE source = 'landing_page'"
    ),
    "s2_scan_csv": _raw(
        "SELECT date_raw AS c0, nullif(name_raw, '') AS c1, nullif(phone_raw, '') AS c2, nullif(email_raw, '') AS c3, "
        "campaign_raw AS c4, nullif(consent_raw, '') AS c5, count(*) AS n FROM raw WHERE source = 'google_form' GROUP BY ALL"
    ),
    "s3_flatten_webhook": _raw(
        "SELECT seq, campaign_raw AS campaign_id, date_raw AS created_time, name_raw AS full_name, email_raw AS email, "
        "phone_raw AS phone_number, CAST(2 + (name_raw IS NOT NULL)::INT + (email_raw IS NOT NULL)::INT "
        "+ (phone_raw IS NOT NULL)::INT AS BIGINT) AS n_keys FROM raw WHERE source = 'facebook'"
    ),
    "s3b_flatten_all_changes": _raw(
        "SELECT seq, CAST(e AS BIGINT) AS entry_no, CAST(c AS BIGINT) AS change_no, campaign_raw || suffix AS campaign_id, "
        "date_raw AS created_time, name_raw AS full_name, email_raw AS email, phone_raw AS phone_number "
        "FROM raw, (VALUES (0, 0, '-a'), (0, 1, '-b'), (1, 0, '-c')) AS t(e, c, suffix) WHERE source = 'facebook'"
    ),
    "s4_union_sources": _raw("SELECT source, seq FROM raw WHERE source IN ('instagram', 'landing_page')"),
    "s5_slice_records": _with(
        lines() + _PLACED, "SELECT source, seq, pos FROM placed WHERE pos >= 100 AND pos < 1100"
    ),
    "s6_form_batches": _with(lines() + _PLACED, "SELECT source, seq, batch_id, batch_pos FROM batched"),
    "s5_slice_unlanded": _with(
        lines() + _PLACED, "SELECT source, seq, pos FROM placed WHERE pos >= 100 AND pos < 1100"
    ),
    "s6_batches_unlanded": _with(lines() + _PLACED, "SELECT source, seq, batch_id, batch_pos FROM batched"),
    "s7_repeated_lines": _leads(
        "SELECT source, 2 * count(*) AS n, 2 * count(*) AS ids, 2 * count(*) AS kept FROM leads "
        "WHERE source IN ('facebook', 'landing_page') GROUP BY ALL"
    ),
    "s7_stream_replay": _leads(
        "SELECT source, status, count(*) AS n FROM leads WHERE source = 'facebook' GROUP BY ALL"
    ),
    "k1_upsert_leads": _leads(
        "SELECT seq, lead_id, CASE WHEN seq % 6 = 0 THEN 'last' WHEN seq % 3 = 0 THEN 'first' ELSE campaign_id END AS campaign_id, "
        "CASE WHEN seq % 6 = 0 THEN '2026-08-02 01:00:00' WHEN seq % 3 = 0 THEN '2026-08-02 00:00:00' "
        f"ELSE {INGEST} END AS ingested_at FROM leads"
    ),
    "k1_leads_table": _leads(
        "SELECT seq, lead_id, CASE WHEN seq % 6 = 0 THEN 'last' WHEN seq % 3 = 0 THEN 'first' ELSE campaign_id END AS campaign_id, "
        "CASE WHEN seq % 6 = 0 THEN '2026-08-02 01:00:00' WHEN seq % 3 = 0 THEN '2026-08-02 00:00:00' "
        f"ELSE {INGEST} END AS ingested_at FROM leads"
    ),
    "k2_heal_events": (
        "SELECT source, 'human_review' AS event, CAST(0 AS BIGINT) AS attempt, length(text) AS width, "
        f"md5(text) AS digest, {INGEST} AS ts FROM documents"
    ),
    "k3_review_queue": _with(
        _BROKEN, "SELECT source, violations AS reason, seq FROM broken WHERE violations <> ''"
    ),
    "k4_mapping_store": _with(
        _MAPPING_LOG,
        "SELECT source, state, count(*) AS versions, CAST(sum(CASE WHEN state = 'approved' THEN 3 ELSE 0 END) AS BIGINT) AS fields "
        "FROM versions GROUP BY ALL",
    ),
    "k5_table_contract": _leads(
        "SELECT lead_id, source, CAST(NULL AS VARCHAR) AS email, FALSE AS consent, "
        f"CAST(quality_score AS BIGINT) AS quality_score, {INGEST} AS ingested_at FROM leads"
    ),
    "k6_rename_fields": _raw(
        f"SELECT seq, CASE WHEN seq < {HALF} THEN name_raw END AS full_name, "
        f"CASE WHEN seq >= {HALF} THEN name_raw END AS applicant_name, "
        f"CASE WHEN seq < {HALF} THEN phone_raw END AS phone_number, "
        f"CASE WHEN seq >= {HALF} THEN phone_raw END AS contact_phone FROM raw WHERE source = 'facebook'"
    ),
    "p1_apply_mapping": _leads(
        "SELECT seq, source, first_name, last_name, email, phone_e164, campaign_id, consent, "
        f"strftime(created_at, {TS}) AS created_at FROM leads"
    ),
    "p1_last_field_wins": _leads(
        "SELECT seq, CAST(NULL AS VARCHAR) AS email, phone_e164, concat_ws(',', phone_flag, email_typo, email_flag, 'email_missing', "
        "CASE WHEN first_name IS NULL AND last_name IS NULL THEN 'name_missing' END) AS flags FROM leads WHERE source = 'facebook'"
    ),
    "p2_raw_payload": _raw(
        "SELECT seq, CASE WHEN source IN ('instagram', 'google_form') THEN nullif(email_raw, '') ELSE email_raw END AS email, "
        "CASE WHEN source = 'landing_page' THEN first_raw WHEN source = 'facebook' THEN name_raw ELSE nullif(name_raw, '') END AS name, "
        "CAST(CASE source WHEN 'facebook' THEN 2 + (name_raw IS NOT NULL)::INT + (email_raw IS NOT NULL)::INT + (phone_raw IS NOT NULL)::INT "
        "WHEN 'landing_page' THEN 8 + (phone_raw IS NOT NULL)::INT ELSE 6 END AS BIGINT) AS keys FROM raw"
    ),
    "p3_clean_name": _leads(
        "SELECT seq, full_name AS name FROM leads"
    ),
    "p4_split_full_name": _leads(
        "SELECT seq, split_part(full_name, ' ', 1) AS first_name, "
        "CASE WHEN strpos(full_name, ' ') > 0 THEN substr(full_name, strpos(full_name, ' ') + 1) END AS last_name FROM leads"
    ),
    "p5_clean_email": _leads("SELECT seq, email, email_flag FROM leads"),
    "p5_emails_in_documents": f"""
WITH words AS (
  SELECT doc_id, lower(w) AS e FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)
  WHERE w LIKE '%@%'
),
fixed AS (
  SELECT doc_id, CASE split_part(e, '@', -1) WHEN 'gmial.com' THEN 'gmail.com' WHEN 'gamil.com' THEN 'gmail.com'
    WHEN 'yaho.com' THEN 'yahoo.com' WHEN 'hotmial.com' THEN 'hotmail.com' WHEN 'outlok.com' THEN 'outlook.com' END AS fix, e
  FROM words
),
addressed AS (
  SELECT doc_id, CASE WHEN fix IS NULL THEN e ELSE substr(e, 1, length(e) - length(split_part(e, '@', -1))) || fix END AS a
  FROM fixed
),
judged AS (
  SELECT doc_id, a, regexp_matches(a, '{ADDRESS}') AND length(a) <= 254 AND length(split_part(a, '@', 1)) <= 64
    AND split_part(a, '.', -1) NOT IN ('arpa', 'invalid', 'local', 'localhost', 'onion', 'test') AS ok
  FROM addressed
)
SELECT doc_id, CASE WHEN ok THEN a END AS email,
  CASE WHEN NOT ok THEN 'email_invalid'
       WHEN split_part(a, '@', 2) IN ('test.com', 'example.com', 'example.org', 'example.net', 'asdf')
         OR split_part(a, '@', 1) IN ('test', 'asdf', 'aaa') THEN 'email_junk' END AS email_flag,
  count(*) AS n
FROM judged GROUP BY ALL""",
    "p6_typo_domain": _leads(
        "SELECT seq, email, email_typo FROM leads WHERE email_typo IS NOT NULL"
    ),
    "p7_junk_email": _leads(
        "SELECT email, count(*) AS n FROM leads WHERE email_flag = 'email_junk' GROUP BY email"
    ),
    "p8_clean_phone": _leads("SELECT seq, phone_e164 AS phone, phone_flag FROM leads"),
    "p9_clean_date": _leads(f"SELECT seq, strftime(created_at, {TS}) AS created_at FROM leads"),
    "p9_dates_of_every_style": f"""
SELECT o_orderkey AS seq, style, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), {TS}) AS created_at
FROM orders, (VALUES ('iso'), ('offset'), ('epoch'), ('month_first'), ('half_day'), ('day_name'), ('name_day'), ('compact')) AS t(style)""",
    "p10_consent": _leads("SELECT seq, consent FROM leads"),
    "p11_campaign": _raw("SELECT seq, CASE WHEN seq % 10 <> 0 THEN campaign_raw END AS campaign_id FROM raw"),
    "p12_defaults": _leads(
        "SELECT seq, CASE WHEN late THEN " + INGEST + f" ELSE strftime(created_at, {TS}) END AS created_at, "
        "concat_ws(',', CASE WHEN source = 'google_form' THEN phone_flag END, email_typo, email_flag, "
        "CASE WHEN source <> 'google_form' THEN phone_flag END, CASE WHEN late THEN 'date_missing' END, "
        "CASE WHEN first_name IS NULL AND last_name IS NULL THEN 'name_missing' END) AS flags, "
        "CASE WHEN late THEN 'flagged' ELSE status END AS status "
        "FROM (SELECT *, seq % 5 = 0 AND source IN ('facebook', 'landing_page') AS late FROM leads)"
    ),
    "p13_flags": _leads("SELECT seq, flags FROM leads"),
    "p14_status": _leads("SELECT seq, status FROM leads"),
    "p15_lead_id": _leads("SELECT seq, lead_id FROM leads"),
    "p15_occurrence": (
        "SELECT event_id AS seq, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) - 1 AS occurrence_no FROM events"
    ),
    "p15_ids_survive": _with(
        lines(), "SELECT seq, seq % 2 = 0 AS kept FROM lines WHERE source = 'landing_page'"
    ),
    "p16_quality_score": _leads("SELECT seq, CAST(quality_score AS BIGINT) AS quality_score FROM leads"),
    "p17_contract": _leads(
        "SELECT seq, concat_ws(',', CASE WHEN seq % 11 = 0 THEN 'source_unknown' END, "
        "CASE WHEN seq % 29 = 0 THEN 'created_at_missing' END, CASE WHEN seq % 13 = 0 THEN 'phone_not_e164' END, "
        "CASE WHEN seq % 17 = 0 THEN 'score_range' END, CASE WHEN seq % 19 = 0 THEN 'status_unknown' END, "
        "CASE WHEN seq % 23 = 0 THEN 'payload_not_json' END) AS violations FROM leads"
    ),
    "p18_split_valid": _with(_BROKEN, "SELECT seq, violations FROM broken"),
    "m1_profile": _with(lines() + _SIZES + _cells("lines"), _profile("present")),
    "m1_profile_everything": f"""
WITH rows AS (
  SELECT event_type AS source, event_id AS seq, props FROM events
),
sizes AS (SELECT source, count(*) AS n FROM rows GROUP BY source),
present AS (
  SELECT source, seq, unnest(json_keys(props)) AS field, props FROM rows
)
SELECT p.source, p.field, any_value(s.n) AS n, count(*) AS present,
       array_to_string(list_transform(list_slice(list_sort(
         list({{'at': p.seq, 'v': json_extract_string(props, '$.' || field)}})), 1, 4), lambda x: x.v), '|') AS samples
FROM present p JOIN sizes s USING (source) GROUP BY p.source, p.field""",
    "m2_missing_counts": _with(_DRIFT, "SELECT source, batch_id, n, field, missing FROM missing"),
    "m3_unmapped_fields": _with(_DRIFT, "SELECT source, batch_id, field FROM unmapped"),
    "m4_drift_decision": _with(
        _DRIFT, "SELECT source, batch_id, n, failed, dead_fields, drifted FROM decision"
    ),
    "m5_drift_report": _with(
        _DRIFT,
        """SELECT d.source, d.batch_id, d.n, d.failed, d.dead_fields,
  coalesce((SELECT string_agg(u.field, ',' ORDER BY u.field) FROM unmapped u WHERE u.source = d.source AND u.batch_id = d.batch_id), '') AS unmapped,
  '' AS errors,
  (SELECT string_agg(p.field, ',' ORDER BY p.field) FROM present p JOIN batched b USING (source, seq)
   WHERE b.source = d.source AND b.batch_id = d.batch_id AND b.batch_pos = 0) AS first_keys
FROM decision d WHERE d.drifted""",
    ),
    "m6_validate_mapping": _with(_PROPOSALS, "SELECT source, reason FROM verdicts"),
    "m6_completed_mapping": _with(
        _PROPOSALS,
        """SELECT source, ordinal, field, transform FROM proposal JOIN verdicts USING (source) WHERE reason IS NULL
UNION ALL SELECT source, 3 + ordinal, field, 'ignore' FROM profile JOIN verdicts USING (source)
WHERE reason IS NULL AND field NOT IN ('name', 'mail', 'tel')""",
    ),
    "m7_infer_mapping": _golden(vocab.KNOWN_MAPPINGS),
    "m7_infer_renamed": _golden({"facebook": _RENAMED_MAPPING}),
    "m7_infer_every_half": f"""SELECT source, late, field, transform FROM (
  SELECT *, false AS late FROM ({_golden(vocab.KNOWN_MAPPINGS)})
  UNION ALL SELECT *, true FROM ({_golden({**vocab.KNOWN_MAPPINGS, "facebook": _RENAMED_MAPPING})}))""",
    "m7_infer_unnamed": _golden({
        "kunden": {"kontakt": "email", "nummer": "phone", "segment": "ignore", "saldo": "ignore"},
        "fornitori": {"tlf": "phone", "posta": "email", "firma": "ignore"},
        "brukere": {"art": "ignore", "dato": "created_at", "avsender": "email"},
    }),
    "m8_current_mappings": _with(
        _MAPPING_LOG,
        """SELECT e.source, e.version, e.ordinal, e.field, e.transform FROM entries e
JOIN (SELECT source, max(version) AS version FROM versions GROUP BY source) USING (source, version)""",
    ),
    "m9_remember_fields": _with(
        _MAPPING_LOG,
        f"""SELECT id, transform, doc, version FROM (
  SELECT e.source || '::' || e.field AS id, e.transform, {_DOC} AS doc, e.version,
         row_number() OVER (PARTITION BY e.source, e.field ORDER BY e.version DESC) AS rn
  FROM entries e LEFT JOIN customer c ON 'form-' || c.c_custkey = e.source WHERE e.transform <> 'ignore')
WHERE rn = 1""",
    ),
    "m10_nearest_vectors": """
WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 5) AS distance
FROM embeddings, q ORDER BY distance, vec_id LIMIT 6""",
    "m10_nearest_by_cosine": """
WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(1 - list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS distance
FROM embeddings, q ORDER BY distance, vec_id LIMIT 6""",
    "m10_similar_fields": _with(
        _DESCRIBED + f""",
texts AS (
  SELECT source, late, field, min({{'at': seq, 'place': place}}) AS first, {_sample_text(2)} AS text FROM halves GROUP BY source, late, field
),
asked AS (
  SELECT source || '/' || late AS id, source, late, string_agg(text, ' ' ORDER BY first, field) AS text FROM texts GROUP BY source, late
)""" + _NEAREST,
        "SELECT source, late, rank, n.id, transform FROM nearest n JOIN asked a ON a.id = n.qid JOIN kept k ON k.id = n.id",
    ),
    "m10_similar_by_field": _with(
        _DESCRIBED + f""",
asked AS (
  SELECT source || '/' || late || '/' || field AS id, source, late, field, {_sample_text(3)} AS text FROM halves GROUP BY source, late, field
)""" + _NEAREST,
        "SELECT source, late, field, rank, n.id, transform, round(similarity, 9) AS similarity "
        "FROM nearest n JOIN asked a ON a.id = n.qid JOIN kept k ON k.id = n.id",
    ),
    "m10_index_recall": _with(
        _DESCRIBED,
        "SELECT source, (SELECT count(*) FROM (SELECT DISTINCT source, late, field FROM halves) h WHERE h.source = s.source) * 6 AS n, "
        "true AS enough FROM (SELECT DISTINCT source FROM halves) s",
    ),
    "m11_heal_leads": _with(
        leads(False) + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) - 1 AS pos FROM leads),
ranked AS (
  SELECT source, pos // {BATCH} AS batch_id, status,
         source = 'facebook' AND seq >= {HALF} AS renamed FROM placed
),
firstdrift AS (
  SELECT min(batch_id) AS b FROM (
    SELECT batch_id, avg(renamed::INT) AS share FROM ranked WHERE source = 'facebook' GROUP BY batch_id) WHERE share > 0.8
)""",
        # before the drift is caught, renamed rows lack name and phone; in the
        # healed batches old rows would lack them
        """SELECT source, batch_id,
  CASE WHEN renamed AND batch_id < coalesce((SELECT b FROM firstdrift), batch_id + 1) THEN 'flagged' ELSE status END AS status, count(*) AS n
FROM ranked GROUP BY ALL""",
    ),
    "m11_heal_events": _with(
        _DRIFT + ",\nfirstdrift AS (SELECT min(batch_id) AS b FROM decision WHERE drifted)",
        """SELECT CAST(step AS BIGINT) AS step, 'facebook' AS source, b AS batch_id, event, CAST(attempt AS BIGINT) AS attempt
FROM firstdrift, (VALUES (0, 'drift_detected', 0), (1, 'retry', 1), (2, 'healed', 1)) AS t(step, event, attempt)
WHERE b IS NOT NULL""",
    ),
    "m12_give_up": _with(
        _DRIFT,
        """SELECT source, date_raw AS created_time, count(*) AS n FROM batched
WHERE source = 'facebook' AND batch_id >= (SELECT min(batch_id) FROM decision WHERE drifted) GROUP BY ALL""",
    ),
    "m13_record_keys": _with(
        _DRIFT, "SELECT source, field, count(*) AS n FROM present GROUP BY ALL"
    ),
    "d1_candidates": _leads("SELECT * FROM cands", _PAIRS),
    "d2_block_pairs": _leads("SELECT block, first_id, lead_id FROM pairs", _PAIRS),
    "d2_hot_blocks": _leads("SELECT block, first_id, lead_id FROM pairs", _PAIRS),
    "d3_name_similarity": _leads("SELECT a, b, round(similarity, 4) AS similarity FROM ratios", _MATCHED),
    "d4_matched_pairs": _leads("SELECT block, first_id, lead_id FROM matched", _MATCHED),
    "d5_components": _resolved("SELECT node, component FROM components"),
    "d5_hot_components": _resolved("SELECT node, component FROM components"),
    "d6_survivors": _resolved("SELECT component, survivor_id, members FROM groups"),
    "d7_summary": _resolved(
        "SELECT (SELECT count(*) FROM cands) AS scanned, CAST(sum(members - 1) AS BIGINT) AS duplicates, "
        "count(*) FILTER (WHERE cross_source) AS cross_source_groups FROM groups"
    ),
    "d8_marked_leads": _resolved("SELECT lead_id, final_status AS status FROM resolved"),
    "d8_leads_table": _resolved("SELECT lead_id, final_status AS status FROM resolved"),
    "a1_totals": _resolved(
        "SELECT count(*) AS total, count(*) FILTER (WHERE final_status = 'clean') AS clean, "
        "count(*) FILTER (WHERE final_status = 'flagged') AS flagged, "
        "count(*) FILTER (WHERE final_status = 'duplicate') AS dupes, round(avg(quality_score), 1) AS avg_score FROM resolved"
    ),
    "a2_status_by_source": _resolved(
        "SELECT source, count(*) FILTER (WHERE final_status = 'clean') AS clean, "
        "count(*) FILTER (WHERE final_status = 'flagged') AS flagged, "
        "count(*) FILTER (WHERE final_status = 'duplicate') AS duplicate FROM resolved GROUP BY source ORDER BY source"
    ),
    "a3_score_histogram": _resolved(
        "SELECT CAST(quality_score // 10 * 10 AS BIGINT) AS bucket, count(*) AS leads FROM resolved "
        "WHERE final_status <> 'duplicate' GROUP BY 1 ORDER BY 1"
    ),
    "a3_score_exact": _resolved(
        "SELECT CAST(quality_score AS DOUBLE) / 10 * 10 AS bucket, count(*) AS leads FROM resolved "
        "WHERE final_status <> 'duplicate' GROUP BY 1 ORDER BY 1"
    ),
    "a4_latest_events": (
        f"SELECT strftime(ts, {TS}) AS ts, event_type AS source, 'retry' AS event, event_id % 3 AS attempt, props AS detail "
        "FROM events ORDER BY events.ts DESC, source, event, attempt LIMIT 20"
    ),
    "a5_latest_leads": _leads(
        f"SELECT first_name, last_name, email, phone_e164, source, campaign_id, consent, strftime(created_at, {TS}) AS created_at, "
        "CAST(quality_score AS BIGINT) AS quality_score, status, flags FROM leads ORDER BY seq % 10 DESC, lead_id LIMIT 200"
    ),
    "a6_latest_reviews": (
        f"SELECT strftime(ts, {TS}) AS ts, event_type AS source, 'row validation failed' AS reason, props AS raw_payload "
        "FROM events ORDER BY events.ts DESC, source, raw_payload LIMIT 100"
    ),
    "a7_run_report": _with(
        leads(False) + """,
broken AS (
  SELECT *, source = 'landing_page' AND (seq % 97 < 10 OR seq % 89 < 6) AS bad FROM leads
)""",
        "SELECT source, count(*) AS rows, count(*) FILTER (WHERE NOT bad) AS stored, "
        "count(*) FILTER (WHERE NOT bad AND status = 'flagged') AS flagged, count(*) FILTER (WHERE bad) AS failed "
        "FROM broken GROUP BY source ORDER BY source",
    ),
    "a8_run_totals": _resolved(
        "SELECT count(*) AS rows, count(*) AS table_rows, count(*) FILTER (WHERE final_status = 'clean') AS table_clean FROM resolved"
    ),
    "a9_clean_rate": _resolved(
        "SELECT round(avg(CASE WHEN final_status = 'clean' THEN 1.0 ELSE 0.0 END), 6) AS clean_rate FROM resolved"
    ),
}
