"""Registered queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from auditspark.llm import (
    conversations, decontaminate, divergence, html_text, language, licenses, line_quality, mixture, near_dedup, preference, secrets, substring, warc,
)
from auditspark.llm.tables import compact


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return line_quality.judged(documents, line_quality.train(documents, _table(spark, sf_dir, "labels")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.train(documents))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), html_text.train())


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return preference.scored(documents, preference.train(documents, _table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language.predicted(documents, language.train(documents))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, r: n + r["last_word"] - r["first_word"] + 1)
    cleaned = substring.without_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations")
    rows = conversations.damaged(told)
    found = compact(conversations.edits(rows), "edits")
    all_ids = told.select(F.col("conv_id").cast("long").alias("id")).distinct()
    with_audit = all_ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    digest = conversations.digests(rows, found)
    full = with_audit.join(digest, F.col("id").eqNullSafe(digest["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_quality": op1_line_quality,
    "op2_secrets": op2_secrets,
    "op3_mixture": op3_mixture,
    "op4_licenses": op4_licenses,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_text": op7_html_text,
    "op8_preference": op8_preference,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_conversations": op12_conversations,
    "op13_divergence": op13_divergence,
}

def _template(n: int, label: str, text: str) -> str:
    """A row (template, label, words of a block, least common words, its different words in order)."""
    words = text.split()
    different = list(dict.fromkeys(words))
    return f"({n}, '{label}', {licenses.SPREAD * len(words)}, ceil({licenses.CONTAINED} * {len(different)} - 1e-9), {different})"


_TEMPLATES = ", ".join(_template(n, *template) for n, template in enumerate(licenses.TEMPLATES + licenses.PASSAGES))

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_N = len(secrets.ALPHABET) + 1


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, rank: int, pattern: str, least: int, source: str = "slim") -> str:
    """Matches of one kind with their places: what stands between them gives the lengths."""
    p = _quoted(pattern)
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start_, start_ + len(f[i]) AS end_, v[i] AS value FROM (
    SELECT *, coalesce(list_sum(list_transform(b[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) AS start_
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {p}, 0) AS f, regexp_extract_all(text, {p}, 1) AS v, string_split_regex(text, {p}) AS b FROM {source}) m) n) o
  WHERE len(v[i]) >= {least}"""


_PAIRS = f"""SELECT label, unnest(list_transform(range(1, len(c)), lambda i: c[i] * {_N} + c[i + 1])) AS pair FROM (
    SELECT label, list_transform(string_split(token, ''), lambda x: instr('{secrets.ALPHABET}', x)) AS c FROM tokens) t"""
_RATIO = f"""list_sum(list_transform(range(1, len(value)), lambda i:
    ratios[instr('{secrets.ALPHABET}', substr(value, i, 1)) * {_N} + instr('{secrets.ALPHABET}', substr(value, i + 1, 1)) + 1]))"""
_PLAIN = "text"
for _pattern in (secrets.ASSIGN, secrets.ACCESS, "[0-9a-f]{24,}", secrets.TOKEN):
    _PLAIN = f"regexp_replace({_PLAIN}, {_quoted(_pattern)}, ' ', 'g')"

ORACLE = {
    "op2_secrets": f"""
WITH slim AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({' UNION ALL '.join(_matches(kind, n, pattern, least) for n, (kind, pattern, least) in enumerate(secrets.KINDS))}),
plain AS (
  SELECT {_PLAIN} AS text FROM slim),
tokens AS (
  SELECT 0 AS label, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]{{3,}}')) AS token
  FROM (SELECT text FROM plain UNION ALL SELECT replace(text, ' ', '_') FROM plain) p
  UNION ALL SELECT 1, value FROM base
  UNION ALL SELECT 1, to_base64(unhex(sha256(CAST(i AS VARCHAR)))) FROM range({secrets.MADE}) r(i)),
counts AS (SELECT label, pair, count(*) AS n FROM ({_PAIRS}) p GROUP BY ALL),
grid AS (
  SELECT label, pair, 1 + coalesce(n, 0) AS n FROM (SELECT label, pair FROM range(2) a(label), range({_N * _N}) b(pair)) g LEFT JOIN counts USING (label, pair)),
chances AS (SELECT label, pair, ln(n::DOUBLE / sum(n) OVER (PARTITION BY label, pair // {_N})) AS c FROM grid),
model AS (
  SELECT list(round(r.c - o.c, 6) ORDER BY r.pair) AS ratios,
    greatest({secrets.MARGIN}::DOUBLE, {secrets.LETTERS_SHARE}::DOUBLE * round(avg(round(r.c - o.c, 6)) FILTER (
      WHERE r.pair // {_N} BETWEEN 1 AND 52 AND r.pair % {_N} BETWEEN 1 AND 52), 6)) AS letters_margin
  FROM chances r JOIN chances o ON r.pair = o.pair AND r.label = 1 AND o.label = 0),
added AS (
  SELECT doc_id, kind, rank, start_, end_ FROM ({_matches('random', len(secrets.KINDS), f'({secrets.TOKEN})', 0)}) c, model
  WHERE regexp_matches(value, '[A-Za-z]')
    AND {_RATIO} >= CASE WHEN regexp_matches(value, '[0-9]') THEN {secrets.MARGIN} ELSE letters_margin END::DOUBLE * (len(value) - 1)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start_ < c.end_ AND c.start_ < b.end_)),
told AS (
  SELECT doc_id, string_agg(s, ',' ORDER BY start_, rank) FILTER (WHERE rank < {len(secrets.KINDS)}) AS base_said, string_agg(s, ',' ORDER BY start_, rank) AS said,
    {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _, _ in secrets.KINDS)}
  FROM (SELECT *, kind || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT) AS s FROM (
    SELECT doc_id, kind, rank, start_, end_ FROM base UNION ALL SELECT * FROM added) u) w GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k, _, _ in secrets.KINDS)},
  sha256(coalesce(base_said, '')) AS base_sha256, coalesce(said, '') AS spans
FROM slim LEFT JOIN told USING (doc_id)
""",
    "op3_mixture": rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS top,
    ((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER (
       ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
common AS (
  SELECT level FROM levels WHERE level * weight <= top ORDER BY top::DOUBLE / weight, source NULLS FIRST LIMIT 1),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
    CASE WHEN level * weight <= top THEN (SELECT level FROM common) * weight ELSE top::DOUBLE END AS target FROM levels),
wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
lefts AS (SELECT *, target - whole * source_size AS remaining FROM wholes),
counted AS (
  SELECT c.source, c.size, l.remaining,
    coalesce(sum(c.m * c.size) OVER (PARTITION BY c.source ORDER BY c.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    (sum((c.m * c.size * c.size)::HUGEINT) OVER (PARTITION BY c.source ORDER BY c.size ROWS UNBOUNDED PRECEDING))::DOUBLE AS squares
  FROM (SELECT source, size, count(*) AS m FROM sized WHERE size > 0 GROUP BY ALL) c
  JOIN lefts l ON c.source IS NOT DISTINCT FROM l.source),
rates AS (
  SELECT source, max_by((remaining - above::DOUBLE) / squares, size) AS rate, max_by(above, size) AS above, max(size) AS largest
  FROM counted WHERE (remaining - above::DOUBLE) / squares * size < 1 GROUP BY source),
drawn AS (
  SELECT s.doc_id, s.size, l.source, l.source_size, l.target, l.whole, l.remaining - coalesce(r.above, 0)::DOUBLE AS open,
    coalesce(r.rate, 0) * s.size AS chance, s.size > coalesce(r.largest, 0) AS certain,
    (CAST('0x' || substr(md5('mixture-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN lefts l ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN rates r ON l.source IS NOT DISTINCT FROM r.source),
ranked AS (
  SELECT *, CASE WHEN size > 0 AND NOT certain AND chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM drawn),
reached AS (
  SELECT *, coalesce(sum(CASE WHEN odds IS NOT NULL THEN size END) OVER (
    PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN certain THEN 1 WHEN odds IS NOT NULL AND before + size / 2.0::DOUBLE <= open THEN 1 ELSE 0 END))::BIGINT AS taken
FROM reached
""",
    "op4_licenses": rf"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT k, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS spot
  FROM words, (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) f(p, label)),
base AS (
  SELECT k, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY k),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) f(t, label, width, needed, d)),
members AS (SELECT t, unnest(d) AS word, unnest(range(1, len(d) + 1)) AS i FROM templates),
held AS (
  SELECT k, t, list({{'place': place, 'i': i}} ORDER BY place) AS h
  FROM (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS place FROM words) x JOIN members USING (word) JOIN templates USING (t)
  GROUP BY k, t, needed HAVING count(DISTINCT i) >= needed),
starts AS (SELECT k, t, h, unnest(range(1, len(h) + 1)) AS s FROM held),
blocks AS (
  SELECT DISTINCT k, t, label, len(d) AS n, needed, list_transform(list_filter(h[s:s + width], lambda x: x['place'] < h[s]['place'] + width), lambda x: x['i']) AS b
  FROM starts JOIN templates USING (t)),
met AS (
  SELECT k, label, max(common)::DOUBLE / n AS score FROM (
    SELECT *, list_max(list_transform(list_reduce(list_prepend([{{'i': 0::BIGINT, 'c': 0::BIGINT}}], list_transform(b, lambda x: [{{'i': x::BIGINT, 'c': 0::BIGINT}}])),
      lambda known, x: list_append(known, {{'i': x[1]['i'], 'c': 1 + list_max(list_transform(list_filter(known, lambda y: y['i'] < x[1]['i']), lambda y: y['c']))}})),
      lambda y: y['c'])) AS common FROM blocks WHERE len(list_distinct(b)) >= needed) c
  WHERE common >= needed GROUP BY k, t, label, n),
added AS (SELECT k, list(label) AS labels, max(score) AS score FROM met GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(added.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (k) LEFT JOIN added USING (k)
""",
    "op5_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""",
    "op9_warc": r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * g, 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS INTEGER) + 1, 1)), '')), '') AS d
  FROM payloads)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to
FROM coded
""",
    "op11_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM spots),
least AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (g) WHERE first_doc < doc_id),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS text FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
    "op12_conversations": r"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS said FROM conversations),
marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(said, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 20 AS fault
  FROM told),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE fault <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
convs AS (
  SELECT conv_id, count(*) AS n, list(initial ORDER BY i) AS initials, list(fault ORDER BY i) AS faults,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS i, [{'c': 0::BIGINT, 'a': ''}, {'c': 9::BIGINT, 'a': 'III'}, {'c': 3::BIGINT, 'a': 'I'}, {'c': 0::BIGINT, 'a': ''}] AS best FROM convs
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda s: list_sort([
      {'c': own[s]['c'], 'a': own[s]['a']}, {'c': 3 + own[step[s]]['c'], 'a': 'I' || own[step[s]]['a']},
      {'c': 6 + own[step[step[s]]]['c'], 'a': 'II' || own[step[step[s]]]['a']}, {'c': 9 + own[step[step[step[s]]]]['c'], 'a': 'III' || own[step[step[step[s]]]]['a']}])[1])
  FROM (
    SELECT w.conv_id, w.i, [3, 3, 4, 3] AS step, list_transform([1, 2, 3, 4], lambda s: list_sort([
        {'c': 4 + best[s]['c'], 'a': 'D' || best[s]['a']},
        CASE WHEN fault IN ('blank', 'duplicate') THEN {'c': 1000000000000::BIGINT, 'a': ''}
          ELSE {'c': 3 + extra + best[[3, 3, 4, 3][s]]['c'], 'a': 'R' || best[[3, 3, 4, 3][s]]['a']} END,
        CASE WHEN fault IN ('blank', 'duplicate') THEN {'c': 1000000000000::BIGINT, 'a': ''}
          WHEN initial = 's' AND s = 1 THEN {'c': extra + best[2]['c'], 'a': 'K' || best[2]['a']}
          WHEN initial = 'u' AND s <> 3 THEN {'c': extra + best[3]['c'], 'a': 'K' || best[3]['a']}
          WHEN initial = 'a' AND s = 3 THEN {'c': extra + best[4]['c'], 'a': 'K' || best[4]['a']}
          ELSE {'c': 1000000000000::BIGINT, 'a': ''} END])[1]) AS own
    FROM (SELECT w.*, c.faults[w.i] AS fault, c.initials[w.i] AS initial, CASE c.faults[w.i] WHEN 'truncated' THEN 3 ELSE 0 END AS extra
          FROM walk w JOIN convs c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.i > 0) w) o),
audits AS (SELECT conv_id, best[1]['c'] AS cost, best[1]['a'] AS audit FROM walk WHERE i = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, len(audit) + 1)) AS k FROM audits WHERE audit <> ''),
counted AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS row, count(*) FILTER (WHERE letter <> 'D') OVER w AS out
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
taken AS (
  SELECT c.conv_id, c.k, c.letter, c.out, j.role, j.text, c.out = 1 AND c.letter = 'K' AND j.initial = 's' AS lead
  FROM counted c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id AND c.row = j.i AND c.letter <> 'I' WHERE c.letter <> 'D'),
headed AS (SELECT *, max(lead::INTEGER) OVER (PARTITION BY conv_id) AS heads FROM taken),
shown AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - heads) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS text
  FROM headed GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(s.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN convs c ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN shown s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
""",
    "op13_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS ln FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.ln + 5)) // (l.total + 5 * l.v) AS q
  FROM sizes g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
over AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM over) t WHERE rank <= 50
""",
}
