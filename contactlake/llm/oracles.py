"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from contactlake.llm import chat, linefreq, resample, warc

_WORDS = r"'[\x20\x09-\x0D]+'"

OP7 = rf"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, doc_id, host, text,
    list_filter(string_split_regex(text, {_WORDS}), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM given
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM cut)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r
), lines AS (
  SELECT r, host, len(list_filter(string_split_regex(line, {_WORDS}), lambda x: x <> '')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT r, host, unnest(lines) AS line FROM cut)
), shared AS (
  SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT r) > {linefreq.MAX_LINE_DOCS}
), removed AS (
  SELECT r, sum(n)::BIGINT AS n FROM lines SEMI JOIN shared USING (host, line) GROUP BY r
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM cut LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT *, n_words < {linefreq.MIN_WORDS} OR 100 * n_repeat_words > {linefreq.MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {linefreq.MIN_WORDS} OR 100 * n_repeat_words > {linefreq.MAX_REPEATED} * n_words)
    AND n_words - n_removed_words >= {linefreq.MIN_LEFT} * n_words AS kept
FROM counts
"""

OP8 = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') AS content,
    (floor(coalesce(turn, 0) / {chat.BLOCK_TURNS}))::BIGINT AS block
  FROM conversations
), sides AS (
  SELECT DISTINCT conv_id AS c, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> '{chat.SCENE}'
), shown AS (
  SELECT conv_id, speaker, block, turn, role, content,
    CASE WHEN role = speaker THEN '{chat.START}assistant' WHEN role = '{chat.SCENE}' THEN '{chat.START}{chat.SCENE}'
      ELSE '{chat.START}user name=' || coalesce(regexp_replace(role, '[\x20\x09-\x0D<>|]', '_', 'g'), '{chat.UNNAMED}') END
      || chr(10) AS head,
    content || '{chat.END}' AS body, coalesce(role = speaker, false) AS own
  FROM turns JOIN sides ON conv_id IS NOT DISTINCT FROM c
), placed AS (
  SELECT *, row_number() OVER w AS place, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS first
  FROM shown WINDOW w AS (
    PARTITION BY conv_id, speaker, block ORDER BY turn NULLS FIRST, role NULLS FIRST, content ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, speaker, block, 0::BIGINT AS part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg((first::BIGINT) || ':' || ((first + length(body))::BIGINT), ',' ORDER BY place) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, speaker, block
"""

#: CRC-32 of texts in SQL: the table of single bytes, and a fold over a text's bytes
_CRC_TABLE = f"""SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {resample.POLYNOMIAL}) ELSE c >> 1 END, n)) AS steps"""


def _crc32(text: str) -> str:
    digits = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(
    list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda c, b: xor(steps[(xor(c & 255, b) + 1)::BIGINT], c >> 8), 4294967295::BIGINT))"""


#: the rows after damage, in order, with initials and faults
_DAMAGED = rf"""
crc AS ({_CRC_TABLE}), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations
), struck AS (
  SELECT *, {_crc32("place")} % 20 AS c FROM given, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM struck, unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 32), substr(text, 1, 32),
      unhex(sha1(role || chr(10) || text))) AS n,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM damaged
), marked AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN said = '' THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
    WHEN said[-1] IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault
  FROM placed
)"""

#: the lightest repair by a shortest path over rows and states; ties by the audit
OP11 = rf"""
WITH RECURSIVE {_DAMAGED}, edges AS (
  SELECT * FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) AS e(p, q)
), gaps AS (  -- insertions of up to two turns
  SELECT p AS f, p AS t, 0 AS cost, '' AS letters FROM (VALUES (''), ('s'), ('u'), ('a')) AS e(p)
  UNION ALL SELECT p, q, 3, 'I' FROM edges WHERE q <> 's'
  UNION ALL SELECT a.p, b.q, 6, 'II' FROM edges a JOIN edges b ON a.q = b.p WHERE a.q <> 's' AND b.q <> 's'
), edits AS (
  SELECT conv_id, n, 'D' AS letter, '' AS gets, 4 AS cost FROM marked
  UNION ALL SELECT conv_id, n, 'K', initial, CASE fault WHEN 't' THEN 3 ELSE 0 END FROM marked
    WHERE fault IN ('.', 't') AND initial IN ('s', 'u', 'a')
  UNION ALL SELECT conv_id, n, 'R', r, 3 + CASE fault WHEN 't' THEN 3 ELSE 0 END
    FROM marked, (VALUES ('u'), ('a')) AS e(r) WHERE fault IN ('.', 't') AND initial <> r
), path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, '' AS state, 0 AS cost, '' AS audit FROM damaged
  UNION ALL
  SELECT conv_id, n, state, w.cost, w.audit FROM (
    SELECT e.conv_id, e.n, CASE e.letter WHEN 'D' THEN g.t ELSE e.gets END AS state,
      min({{'cost': p.cost + g.cost + e.cost, 'audit': p.audit || g.letters || e.letter}}) AS w
    FROM path p JOIN gaps g ON p.state = g.f
      JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1
    WHERE e.letter = 'D' OR EXISTS (FROM edges x WHERE x.p = g.t AND x.q = e.gets)
    GROUP BY ALL)
), ends AS (
  SELECT conv_id, max(n) AS n FROM marked GROUP BY conv_id
), best AS (
  SELECT p.conv_id, min({{'cost': p.cost + g.cost, 'audit': p.audit || g.letters}}) AS w
  FROM path p JOIN ends e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n
    JOIN gaps g ON p.state = g.f WHERE g.t IN ('', 'a') GROUP BY p.conv_id
), letters AS (  -- every edit with the row it is for, and the turn that its role follows
  SELECT conv_id, i, substr(audit, i, 1) AS letter, length(replace(substr(audit, 1, i), 'I', '')) AS n
  FROM (SELECT conv_id, w.audit AS audit, unnest(range(1, length(w.audit) + 1)) AS i FROM best)
), turns AS (
  SELECT l.conv_id, l.i, l.letter, m.role, CASE l.letter WHEN 'I' THEN '' ELSE m.text END AS text,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) AS place
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.n = l.n WHERE l.letter <> 'D'
), parity AS (  -- after the system turn, odd places are the user's
  SELECT *, place - count(*) FILTER (letter = 'K' AND role[1] = 's') OVER (PARTITION BY conv_id) AS spoken FROM turns
), repaired AS (
  SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN spoken % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || text, chr(10) ORDER BY i) AS said FROM parity GROUP BY conv_id
), pairs AS (
  SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY n) AS pair FROM marked
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated FROM marked GROUP BY conv_id
), broken AS (
  SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id
)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
  coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(x.illegal, 0)::BIGINT AS illegal, coalesce(b.w.cost, 0)::BIGINT AS cost, coalesce(b.w.audit, '') AS audit,
  sha256(coalesce(r.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN broken x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12 = rf"""
WITH crc AS ({_CRC_TABLE}), words AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), cut AS (
  SELECT side, r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM words
), runs AS (
  SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS run FROM cut
), counted AS (
  SELECT side, r, run, count(*) AS n FROM runs GROUP BY side, r, run
), hashed AS (
  SELECT run, {_crc32("run")} % {resample.BUCKETS} AS bucket FROM (SELECT DISTINCT run FROM counted), crc
), buckets AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN hashed USING (run) GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM buckets
), gains AS (
  SELECT bucket, floor({resample.SCALE} * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {resample.BUCKETS})
    / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + {resample.BUCKETS})))) AS gain FROM buckets, totals
), sums AS (
  SELECT r, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight
  FROM counted JOIN hashed USING (run) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-{resample.SCALE} * ln(-ln((
      ('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM cut LEFT JOIN sums USING (r) WHERE side = 0
), ranked AS (
  SELECT *, n_words >= {resample.MIN_WORDS} AS fit,
    row_number() OVER (PARTITION BY n_words >= {resample.MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= {resample.MIN_WORDS}) OVER () * {resample.SHARE} // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END::BIGINT AS rank FROM ranked
"""

OP13 = f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY payload_bytes, payload_digest ORDER BY page_id DESC NULLS LAST) AS place,
    max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS largest
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN place = 1 OR payload_bytes < {warc.MIN_REVISIT_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 AND payload_bytes >= {warc.MIN_REVISIT_BYTES} THEN largest END AS refers_to
FROM kept
"""

ORACLES: dict[str, str] = {
    "op7_linefreq": OP7, "op8_chat": OP8, "op11_repair": OP11, "op12_resample": OP12, "op13_warc": OP13,
}
