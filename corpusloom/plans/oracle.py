"""SQL fragments that the oracles share."""

from __future__ import annotations

from corpusloom.functions.text import LINE_END, SPACE
from corpusloom.operators.mixture import BATCH, LANES, STAGES, STEPS, floors

PRETOKEN = r" ?[A-Za-z]+| ?[0-9]| ?[^A-Za-z0-9\s\x0B]+|[\s\x0B]+"

LANES_SQL = """
turns AS (
  SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS next_role, lead(text) OVER w AS response
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), pairs AS (
  SELECT conv_id, turn, prompt, response FROM turns WHERE role = 'user' AND next_role = 'assistant'
), lane_rows AS (
  SELECT 'web' AS lane, doc_id AS number, text AS content FROM documents
  UNION ALL SELECT 'instruct', conv_id * 1000 + turn, CAST(json_object('prompt', prompt, 'response', response) AS VARCHAR) FROM pairs
  UNION ALL SELECT 'code', page_id, html FROM pages
), docs AS (
  SELECT lane || '/' || number AS doc_key, lane, CASE WHEN number % 20 = 0 THEN 'eval' WHEN number % 20 = 1 THEN 'val' ELSE 'train' END AS split, coalesce(content, '') AS content
  FROM lane_rows
)"""

FACTS_SQL = (
    LANES_SQL
    + rf""", features AS (
  SELECT doc_key, lane, split, content, sha256(content) AS content_sha256, len(regexp_extract_all(content, '{PRETOKEN}')) + 1 AS n_tokens,
         regexp_extract_all(content, '[A-Za-z]+') AS words,
         length(regexp_replace(content, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(content, '{SPACE}', '', 'g')) AS n_chars,
         list_filter(list_transform(string_split_regex(content, '{LINE_END}'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS lines
  FROM docs
), counted AS (
  SELECT doc_key, lane, split, content_sha256, n_tokens, len(words) AS n_words, len(list_distinct(list_transform(words, lambda x: lower(x)))) AS n_distinct,
         n_letters, n_chars, len(lines) AS n_lines, len(list_distinct(lines)) AS n_distinct_lines
  FROM features
), facts AS (
  SELECT *, CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      0.80::DOUBLE * (n_distinct::DOUBLE / n_words) + 0.10::DOUBLE * (n_letters::DOUBLE / greatest(n_chars, 1)) + 0.10::DOUBLE * least(1.0::DOUBLE, n_words / 30.0::DOUBLE)
      - 0.40::DOUBLE * CASE WHEN n_lines > 1 THEN 1.0::DOUBLE - n_distinct_lines::DOUBLE / n_lines ELSE 0.0::DOUBLE END)) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS quality
  FROM counted
)"""
)

_lane_rows = ", ".join(f"('{x.name}', {i})" for i, x in enumerate(LANES))
_stage_rows = ", ".join(f"('{s.name}', {s.start}, {s.end}, {s.accept}, {s.reject})" for s in STAGES)
_weight_rows = ", ".join(f"('{s.name}', {', '.join(str(round(s.weights.get(x.name, 0) * 1000)) for x in LANES)})" for s in STAGES)
_floor_rows = ", ".join(f"('{k}', {v})" for k, v in floors().items())
a, b, c = (x.name for x in LANES)

#: Smooth weighted round-robin as a recursion over picks; pick n of a stage belongs to step start + (n - 1) / batch.
PLAN_SQL = f"""
stages(stage, s, e, accept, reject) AS (VALUES {_stage_rows}),
weights(stage, wa, wb, wc) AS (VALUES {_weight_rows}),
floors(lane, floor) AS (VALUES {_floor_rows}),
picks(stage, n, ca, cb, cc, lane) AS (
  SELECT stage, 0, 0, 0, 0, '' FROM weights
  UNION ALL
  SELECT stage, n + 1,
         ca + wa - CASE WHEN ca + wa >= greatest(cb + wb, cc + wc) THEN wa + wb + wc ELSE 0 END,
         cb + wb - CASE WHEN cb + wb > ca + wa AND cb + wb >= cc + wc THEN wa + wb + wc ELSE 0 END,
         cc + wc - CASE WHEN cc + wc > greatest(ca + wa, cb + wb) THEN wa + wb + wc ELSE 0 END,
         CASE WHEN ca + wa >= greatest(cb + wb, cc + wc) THEN '{a}' WHEN cb + wb >= cc + wc THEN '{b}' ELSE '{c}' END
  FROM picks JOIN weights USING (stage) JOIN stages USING (stage) WHERE n < (least(e, {STEPS}) - s + 1) * {BATCH}
), plan AS (
  SELECT step, stage, lane, coalesce(n, 0) AS planned, floor, accept, reject
  FROM (SELECT stage, accept, reject, unnest(range(s, least(e, {STEPS}) + 1)) AS step FROM stages)
  CROSS JOIN floors
  LEFT JOIN (SELECT stage, s + (n - 1) // {BATCH} AS step, lane, count(*) AS n FROM picks JOIN stages USING (stage) WHERE n > 0 GROUP BY ALL) USING (stage, step, lane)
)"""
