"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from varve.llm.quality import MAX_DOCS, MIN_LEFT
from varve.llm.secrets import RULES
from varve.llm.sharding import SHARDS, TABLE_SIZE

_DIGEST = "('0x' || substr(md5({}), 1, 15))::BIGINT"

OP1 = f"""
WITH RECURSIVE shards AS (
  SELECT i::INT AS shard, {_DIGEST.format("'offset:shard-' || i")} % {TABLE_SIZE} AS a0,
         {_DIGEST.format("'skip:shard-' || i")} % ({TABLE_SIZE} - 1) + 1 AS a1
  FROM range({SHARDS}) t(i)
), orders AS (
  SELECT list(struct_pack(a0 := a0, a1 := a1) ORDER BY shard) AS s FROM shards
), fill AS (
  SELECT 0 AS t, list_transform(range({TABLE_SIZE}), lambda x: -1) AS tab, list_transform(range({SHARDS}), lambda x: 0) AS tries FROM orders
  UNION ALL
  SELECT t + 1,
         list_transform(tab, lambda v, i: CASE WHEN i - 1 = (o.a0 + j * o.a1) % {TABLE_SIZE} THEN (t % {SHARDS})::INT ELSE v END),
         list_transform(tries, lambda v, i: CASE WHEN i - 1 = t % {SHARDS} THEN (j + 1)::INT ELSE v END)
  FROM (
    SELECT t, tab, tries, o,
           list_filter(range(tries[t % {SHARDS} + 1], {TABLE_SIZE}), lambda k: tab[(o.a0 + k * o.a1) % {TABLE_SIZE} + 1] = -1)[1] AS j
    FROM (SELECT t, tab, tries, (SELECT s FROM orders)[t % {SHARDS} + 1] AS o FROM fill WHERE t < {TABLE_SIZE})
  )
), slots AS (
  SELECT unnest(range({TABLE_SIZE})) AS slot, unnest(tab) AS shard FROM fill WHERE t = {TABLE_SIZE}
)
SELECT d.doc_id, s.slot, s.shard::INT AS shard
FROM documents d JOIN slots s ON s.slot = {_DIGEST.format("coalesce(d.doc_id::VARCHAR, '')")} % {TABLE_SIZE}
"""



def _rule(rank: int) -> str:
    kind, pattern, group, least = RULES[rank]
    rx = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(gap[1:k]) + coalesce(list_sum(whole[1:k-1]), 0) AS a, list_sum(gap[1:k]) + list_sum(whole[1:k]) AS b
  FROM (SELECT doc_id, list_transform(string_split_regex(t, {rx}), lambda x: length(x)) AS gap, list_transform(regexp_extract_all(t, {rx}, 0), lambda x: length(x)) AS whole,
        list_transform(regexp_extract_all(t, {rx}, {group}), lambda x: length(x)) AS held FROM d WHERE regexp_matches(t, {rx})), unnest(range(1, len(whole) + 1)) r(k) WHERE held[k] >= {least}"""


_JOINED = "coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, rank){}, '')"
OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(map(_rule, range(len(RULES))))})
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256({_JOINED.format(" FILTER (rank < 3)")}) AS base_sha256, {_JOINED.format("")} AS spans, sha256(any_value(d.t)) AS blob
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

_WS = r"[\x20\x09-\x0D]+"
OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[\x20\x09\x0B\x0C\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ks
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], chr(1)) AS w FROM d, unnest(range(1, len(ws) - 3)) r(i) WHERE len(ws) >= 5
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows), range(5) r(k) WHERE c > 1 GROUP BY doc_id
), base AS (
  SELECT d.doc_id, host, ks, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id
), held AS (
  SELECT doc_id, host, ks AS content, unnest(list_distinct(ks)) AS line FROM base
), over AS (
  SELECT host, line, arg_min(content, doc_id) AS first FROM held GROUP BY host, line HAVING count(DISTINCT content) > {MAX_DOCS}
), lost AS (
  SELECT h.doc_id, sum(length(h.line)) AS n FROM held h JOIN over o ON h.host = o.host AND h.line = o.line WHERE h.content <> o.first GROUP BY h.doc_id
), chars AS (
  SELECT doc_id, sum(length(line)) AS n FROM held GROUP BY doc_id
)
SELECT *, NOT base_failed AND NOT (line_chars - removed_chars < {MIN_LEFT} * line_chars) AS kept FROM (
  SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(c.n, 0)::BIGINT AS line_chars, coalesce(l.n, 0)::BIGINT AS removed_chars
  FROM base b LEFT JOIN chars c ON c.doc_id = b.doc_id LEFT JOIN lost l ON l.doc_id = b.doc_id)
"""

ORACLES = {"op1_sharding": OP1, "op2_secrets": OP2, "op3_quality": OP3}
