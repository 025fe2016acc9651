"""DuckDB SQL oracles for the registered queries.

Each oracle takes an independent route where one exists: expected messages
are computed from the conversation rows that the synthetic export lines
were made of (never by parsing those lines), windows are enumerated by
their definition with ``generate_series`` and a range join (not the closed
form), and Python-style word boundaries are emulated with consuming
boundary groups (RE2 has no look-around).
"""

from __future__ import annotations

from .functions import constants as C
from .functions.text import WS_CLASS

WS_SQL = "||".join(f"chr({c})" for lo, hi in C.WHITESPACE_RANGES for c in range(lo, hi + 1))
NL = "chr(10)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re_escape(p: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch not in " _'" else ch for ch in p)


def _word_re(phrases) -> str:
    alts = "|".join(_re_escape(p) for p in phrases)
    return _lit(r"(?i)(^|[^\p{L}\p{N}_])(" + alts + r")([^\p{L}\p{N}_]|$)")


SYS_RE = _word_re(C.SYSTEM_PHRASES)
MEDIA_RE = _word_re(C.MEDIA_PHRASES)
EDIT_RE = _lit(WS_CLASS + "*" + _re_escape(C.EDIT_MARKER) + WS_CLASS + "*")


def trim_ws(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


FX_ROWS = """
fx_rows AS (
  SELECT conv_id, 2 * turn + k AS turn, role, text AS orig_text,
    'chat_' || CAST(conv_id % 4 AS VARCHAR) || '.txt' AS source_file,
    TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST((((conv_id // 4) * 20 + 2 * turn + k) // 2) * 37 AS BIGINT)) AS ts,
    CASE WHEN (conv_id + 2 * turn + k) % 17 = 0 THEN 'Meta AI' ELSE role || '_' || CAST(conv_id % 5 AS VARCHAR) END AS speaker,
    CASE WHEN k = 0 THEN CASE WHEN sel = 3 THEN text || ' <This message was edited>' ELSE text END
      ELSE CASE sel WHEN 1 THEN 'image omitted' WHEN 2 THEN 'Sam left' WHEN 4 THEN 'This message was deleted.' ELSE '   ' END END AS body
  FROM (SELECT conv_id, turn, role, text, (conv_id * 7 + turn) % 23 AS sel, unnest([0, 1]) AS k FROM conversations) c
  WHERE k = 0 OR sel IN (1, 2, 4, 5))"""

FX_MSGS = FX_ROWS + """,
fx_msgs AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
    CAST(2 + coalesce(sum(nl) OVER (PARTITION BY source_file ORDER BY conv_id, turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start
  FROM (SELECT *, len(string_split(body, chr(10))) AS nl FROM fx_rows) r),
fx_clean AS (
  SELECT *, {strip_body} AS strip_text,
    {clean} AS clean_text
  FROM fx_msgs),
fx_msgs_s AS (SELECT *, {strip_body} AS strip_text FROM fx_msgs),
fx_reason AS (
  SELECT *, CASE WHEN speaker = 'Meta AI' THEN 'speaker'
    WHEN regexp_matches(clean_text, {sys}) THEN 'system'
    WHEN regexp_matches(clean_text, {media}) THEN 'media' END AS drop_reason
  FROM fx_clean),
fx_turns AS (
  SELECT timestamp, speaker, clean_text AS text, source_file, line_start, ts,
    row_number() OVER (ORDER BY ts, source_file, line_start) - 1 AS turn_idx
  FROM fx_reason WHERE drop_reason IS NULL AND length(clean_text) > 0)""".format(
    strip_body=trim_ws("body"),
    clean=trim_ws(f"regexp_replace({trim_ws('body')}, {EDIT_RE}, '', 'gi')"),
    sys=SYS_RE, media=MEDIA_RE)

FX_EVENTS = """
fx_events AS (
  SELECT event_id, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, ts, event_type AS speaker, props AS text,
    'u' || CAST(user_id % 8 AS VARCHAR) || '.txt' AS source_file, event_id AS line_start,
    row_number() OVER (ORDER BY ts, 'u' || CAST(user_id % 8 AS VARCHAR) || '.txt', event_id) - 1 AS turn_idx
  FROM events)"""


def windows_cte(name: str, turns: str, chunk: int, stride: int, min_turns: int) -> str:
    """Windows by definition: starts 0, s, 2s, ... <= n - min kept if long
    enough, then the tail start if not produced."""
    return f""",
{name}_n AS (SELECT count(*) AS n FROM {turns}),
{name}_reg AS (
  SELECT s AS start_idx FROM (
    SELECT unnest(generate_series(0, greatest(0, n - {min_turns}), {stride})) AS s, n FROM {name}_n WHERE n >= {min_turns}) q
  WHERE least({chunk}, n - s) >= {min_turns}),
{name}_regk AS (SELECT row_number() OVER (ORDER BY start_idx) - 1 AS chunk_index, start_idx FROM {name}_reg),
{name}_tail AS (
  SELECT (SELECT count(*) FROM {name}_reg) AS chunk_index, greatest(0, n - {chunk}) AS start_idx FROM {name}_n
  WHERE n >= {min_turns} AND greatest(0, n - {chunk}) NOT IN (SELECT start_idx FROM {name}_reg)
    AND least({chunk}, n - greatest(0, n - {chunk})) >= {min_turns}),
{name}_win AS (
  SELECT CAST(w.chunk_index AS BIGINT) AS chunk_index, CAST(w.start_idx AS BIGINT) AS start_turn_index,
    CAST(least({chunk}, n - w.start_idx) AS BIGINT) AS n_turns
  FROM (SELECT * FROM {name}_regk UNION ALL SELECT * FROM {name}_tail) w, {name}_n)"""


def examples_cte(name: str, turns: str, prompt: int) -> str:
    fmt = f"t.speaker || ': ' || t.text"
    p = f"least({prompt}, w.n_turns - 1)"
    return f""",
{name}_ex AS (
  SELECT w.chunk_index, w.start_turn_index, w.n_turns,
    CAST(w.start_turn_index + w.n_turns - 1 AS BIGINT) AS end_turn_index,
    CAST({p} AS BIGINT) AS prompt_turns, CAST(w.n_turns - {p} AS BIGINT) AS completion_turns,
    string_agg({fmt}, chr(10) ORDER BY t.turn_idx) FILTER (WHERE t.turn_idx < w.start_turn_index + {p}) AS prompt_text,
    string_agg({fmt}, chr(10) ORDER BY t.turn_idx) FILTER (WHERE t.turn_idx >= w.start_turn_index + {p}) AS completion_text,
    max(CASE WHEN t.turn_idx = w.start_turn_index + {p} THEN t.speaker END) AS target_speaker,
    max(CASE WHEN t.turn_idx = w.start_turn_index THEN t.timestamp END) AS start_timestamp,
    max(CASE WHEN t.turn_idx = w.start_turn_index + w.n_turns - 1 THEN t.timestamp END) AS end_timestamp,
    max(CASE WHEN t.turn_idx = w.start_turn_index THEN t.source_file END) AS source_file_start,
    max(CASE WHEN t.turn_idx = w.start_turn_index + w.n_turns - 1 THEN t.source_file END) AS source_file_end
  FROM {name}_win w JOIN {turns} t
    ON t.turn_idx >= w.start_turn_index AND t.turn_idx < w.start_turn_index + w.n_turns
  GROUP BY w.chunk_index, w.start_turn_index, w.n_turns)"""


def user_sql(prompt_text: str, speaker: str | None) -> str:
    parts = [_lit(C.PROMPT_HEADER), prompt_text, f"{NL} || {NL}"]
    if speaker:
        parts += [_lit(C.TARGET_SPEAKER_PREFIX), speaker, NL]
    parts.append(_lit(C.PROMPT_INSTRUCTION))
    return " || ".join(parts)


def split_cte(name: str, val: float, test: float) -> str:
    return f""",
{name}_cnt AS (
  SELECT count(*) AS total, CAST(floor(count(*) * {float(test)!r}::DOUBLE) AS BIGINT) AS test_n,
    CAST(floor(count(*) * {float(val)!r}::DOUBLE) AS BIGINT) AS val_n FROM {name}_win),
{name}_split AS (
  SELECT e.*, CASE WHEN e.chunk_index < c.total - c.val_n - c.test_n THEN 'train'
    WHEN e.chunk_index < c.total - c.test_n THEN 'val' ELSE 'test' END AS split
  FROM {name}_ex e, {name}_cnt c)"""


SYSTEM_PROMPT_SQL = _lit(C.DEFAULT_SYSTEM_PROMPT)


# Transcript lines: every row's body is a piece; str.splitlines() boundaries;
# blank lines dropped, kept lines unstripped; dense numbering per transcript.
SPLITLINES_RE = _lit(r"\r\n|[\n\r\x{B}\x{C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]")
CONTEXT_LINES = """,
ctx_raw AS (
  SELECT conv_id AS transcript_id, turn AS seq, unnest(generate_series(1, len(p))) AS pos, unnest(p) AS line
  FROM (SELECT conv_id, turn, regexp_split_to_array(body, {re}) AS p FROM fx_rows) q),
ctx_lines AS (
  SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY seq, pos) AS BIGINT) AS line_no, line
  FROM ctx_raw WHERE length({trimmed}) > 0)""".format(re=SPLITLINES_RE, trimmed=trim_ws("line"))


# Per-key timelines (partition_by=["source_file"]): windows by definition per
# file, chunk order per file, split per file.
PER_FILE_SPLIT = """,
pf_turns AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, line_start) - 1 AS k_idx FROM fx_turns),
pf_n AS (SELECT source_file, count(*) AS n FROM pf_turns GROUP BY source_file),
pf_reg AS (
  SELECT source_file, s AS start_idx, n FROM (
    SELECT source_file, n, unnest(generate_series(0, greatest(0, n - 12), 8)) AS s FROM pf_n WHERE n >= 12) q
  WHERE least(32, n - s) >= 12),
pf_regk AS (
  SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY start_idx) - 1 AS chunk_index, start_idx, n
  FROM pf_reg),
pf_tail AS (
  SELECT p.source_file, (SELECT count(*) FROM pf_reg r WHERE r.source_file = p.source_file) AS chunk_index,
    greatest(0, p.n - 32) AS start_idx, p.n
  FROM pf_n p
  WHERE p.n >= 12 AND NOT EXISTS (SELECT 1 FROM pf_reg r WHERE r.source_file = p.source_file
                                   AND r.start_idx = greatest(0, p.n - 32))),
pf_win AS (
  SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(start_idx AS BIGINT) AS start_turn_index,
    CAST(least(32, n - start_idx) AS BIGINT) AS n_turns
  FROM (SELECT * FROM pf_regk UNION ALL SELECT * FROM pf_tail) w),
pf_cnt AS (
  SELECT source_file, count(*) AS total, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS t10
  FROM pf_win GROUP BY source_file),
pf_split AS (
  SELECT w.source_file, w.chunk_index, w.start_turn_index,
    w.start_turn_index + w.n_turns - 1 AS end_turn_index,
    (SELECT t.speaker FROM pf_turns t WHERE t.source_file = w.source_file
       AND t.k_idx = w.start_turn_index + least(16, w.n_turns - 1)) AS target_speaker,
    CASE WHEN w.chunk_index < c.total - 2 * c.t10 THEN 'train'
         WHEN w.chunk_index < c.total - c.t10 THEN 'val' ELSE 'test' END AS split
  FROM pf_win w JOIN pf_cnt c ON c.source_file = w.source_file)"""


def windows_by_key_cte(name: str, turns: str, key: str, idx: str, chunk: int, stride: int, min_turns: int) -> str:
    """Per-key windows by definition over ``turns`` with a per-key 0-based
    ``idx``; output ``{name}_win(key, chunk_index, start_turn_index, n_turns)``."""
    return f""",
{name}_n AS (SELECT {key}, count(*) AS n FROM {turns} GROUP BY {key}),
{name}_reg AS (
  SELECT {key}, s AS start_idx, n FROM (
    SELECT {key}, n, unnest(generate_series(0, greatest(0, n - {min_turns}), {stride})) AS s FROM {name}_n
    WHERE n >= {min_turns}) q
  WHERE least({chunk}, n - s) >= {min_turns}),
{name}_regk AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY start_idx) - 1 AS chunk_index, start_idx, n
  FROM {name}_reg),
{name}_tail AS (
  SELECT p.{key}, (SELECT count(*) FROM {name}_reg r WHERE r.{key} = p.{key}) AS chunk_index,
    greatest(0, p.n - {chunk}) AS start_idx, p.n
  FROM {name}_n p
  WHERE p.n >= {min_turns} AND least({chunk}, p.n - greatest(0, p.n - {chunk})) >= {min_turns}
    AND NOT EXISTS (SELECT 1 FROM {name}_reg r WHERE r.{key} = p.{key} AND r.start_idx = greatest(0, p.n - {chunk}))),
{name}_win AS (
  SELECT {key}, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(start_idx AS BIGINT) AS start_turn_index,
    CAST(least({chunk}, n - start_idx) AS BIGINT) AS n_turns
  FROM (SELECT * FROM {name}_regk UNION ALL SELECT * FROM {name}_tail) w)"""


ISO_TIMES = """
WITH k AS (SELECT event_id, CASE event_id % 12 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts)
    WHEN 3 THEN ts WHEN 4 THEN date_trunc('day', ts) WHEN 5 THEN date_trunc('week', ts) WHEN 6 THEN date_trunc('second', ts)
    WHEN 7 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 8 THEN date_trunc('millisecond', ts) + INTERVAL 330 MINUTE END AS t FROM events)
SELECT event_id, strftime(CAST(t AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS sort_key, event_id % 12 IN (6, 7, 8) AS aware FROM k
WHERE event_id % 12 < 9 UNION ALL SELECT event_id, NULL, NULL FROM k WHERE event_id % 12 >= 9"""

KEY_REJECTS = """
WITH n AS (SELECT user_id, count(*) FILTER (WHERE user_id % 50 <> 0 AND length(trim(props)) > 0) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n = 0 THEN 'no turns' ELSE 'no examples' END AS reason FROM n WHERE n < 60"""

PARSE_ROUTES = """,
f AS (SELECT *, conv_id // 8 AS file, row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id, turn) AS nth,
        len(string_split(body, chr(10))) AS nl FROM fx_rows),
g AS (SELECT *, CASE WHEN file % 6 IN (3, 4) THEN 1 ELSE 2 END + coalesce(sum(nl) OVER (PARTITION BY file ORDER BY conv_id, turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM f)
SELECT route, 'file=' || CAST(file AS VARCHAR) AS folder, CAST(line_start AS BIGINT) AS line_start, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  speaker, body || CASE WHEN file % 6 = 5 AND nth = 1 THEN chr(65533) ELSE '' END AS text
FROM g, (VALUES ('whole'), ('lines')) r(route) WHERE NOT (file % 6 = 4 AND nth = 1)"""
