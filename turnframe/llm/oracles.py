"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = f"""
  d AS (SELECT row_number() OVER () AS rid, * FROM documents),
  w AS (SELECT rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS ws FROM d)"""

QUALITY_RULES = f"""
WITH {DOCS},
  g AS (SELECT rid, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
  k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM g),
  r AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) x GROUP BY rid),
  l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{PLAIN}')) AS ls FROM w),
  c AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
          CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
          len(ls) AS n_lines
        FROM w JOIN l ON l.rid = w.rid LEFT JOIN r ON r.rid = w.rid),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
          10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines AS soft,
          10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines AS strict FROM c),
  h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS kb,
          count(*) FILTER (WHERE strict)::DOUBLE AS ks FROM f GROUP BY source),
  s AS (SELECT sum(n) AS n, count(*) AS hosts, sum(n * n) AS n2,
          least(greatest(sum(kb) / sum(n), 1e-6), 1 - 1e-6) AS mb, sum(kb * kb / n) AS qb,
          least(greatest(sum(ks) / sum(n), 1e-6), 1 - 1e-6) AS ms, sum(ks * ks / n) AS qs FROM h),
  p AS (SELECT mb, ms,
          CASE WHEN hosts < 2 THEN 2 ELSE least(greatest(mb * (1 - mb) / greatest((qb - n * mb * mb - (hosts - 1) * mb * (1 - mb)) / (n - n2 / n), 1e-9) - 1, 2), 1e6) END AS sb,
          CASE WHEN hosts < 2 THEN 2 ELSE least(greatest(ms * (1 - ms) / greatest((qs - n * ms * ms - (hosts - 1) * ms * (1 - ms)) / (n - n2 / n), 1e-9) - 1, 2), 1e6) END AS ss
        FROM s),
  v AS (SELECT source, CASE WHEN (kb + mb * sb) / (n + sb) >= 0.5 THEN 'blocked'
                            WHEN (ks + ms * ss) / (n + ss) > 2 * ms THEN 'strict' ELSE 'fair' END AS verdict FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND verdict <> 'blocked' AND NOT (CASE WHEN verdict = 'strict' THEN strict ELSE soft END) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS ws FROM benchmark),
  p AS (SELECT DISTINCT item, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
        FROM (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0) x),
  g AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
        FROM (SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
              FROM d, (SELECT DISTINCT k FROM p) ks WHERE len(ws) >= k) x),
  o AS (SELECT rid, i, p.k, item FROM g JOIN p ON p.k = g.k AND p.g = g.g),
  h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS q FROM o) x GROUP BY rid),
  t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN t ON t.rid = d.rid"""

MIX = f"""
WITH {DOCS},
  z AS (SELECT rid, doc_id, source, CAST(len(ws) AS BIGINT) AS size,
          greatest(0.25::DOUBLE, 1.0::DOUBLE - length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::DOUBLE / greatest(len(ws), 1)) AS q,
          (CAST('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM w),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
          (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS wt FROM z GROUP BY source),
  o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(wt) OVER () AS all_w,
          coalesce(sum(3 * source_size) OVER earlier, 0) AS caps_before, coalesce(sum(wt) OVER earlier, 0) AS w_before
        FROM s WINDOW earlier AS (ORDER BY 3 * source_size::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e AS (SELECT *, (total - caps_before)::DOUBLE / (all_w - w_before)::DOUBLE AS level FROM o),
  f AS (SELECT *, min(CASE WHEN level * wt <= cap THEN caps_before END) OVER () AS free_caps FROM e),
  y AS (SELECT source, source_size, CASE WHEN level * wt > cap OR free_caps IS NULL THEN cap::DOUBLE
          ELSE (SELECT any_value(g.level) FROM f g WHERE g.caps_before = f.free_caps AND g.level * g.wt <= g.cap) * wt END AS target FROM f),
  x AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM y),
  b AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS budget FROM x),
  k AS (SELECT z.rid, z.doc_id, z.size, b.source_size, b.target, b.epochs, b.budget,
          coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY -ln(z.u) / z.q, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
        FROM z JOIN b ON z.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - earlier)) AS BIGINT) AS taken FROM k"""

REPEATS = f"""
WITH {DOCS},
  g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
        FROM (SELECT rid, doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13) x),
  m AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
  r AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 12)) AS p FROM g JOIN m ON m.g = g.g WHERE doc_id > first_id),
  t AS (SELECT w.rid, doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM w),
  k AS (SELECT t.rid, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t LEFT JOIN r ON r.rid = t.rid AND r.p = t.p
        WHERE r.p IS NULL GROUP BY t.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.rid = w.rid"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, * FROM documents),
  w AS (SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN}') AS ws FROM d),
  s AS (SELECT DISTINCT rid, doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
        FROM (SELECT rid, doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0) x),
  n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id),
  c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
  l AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
  reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
  m AS (SELECT r.a AS rid, min(n.doc_id) AS low FROM reach r JOIN n ON n.rid = r.b GROUP BY r.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.rid = w.rid LEFT JOIN m ON m.rid = w.rid"""

_NEAREST = """SELECT v.rid, v.part, v.x, min(struct_pack(d := list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), e := c.entry)) AS m
        FROM v JOIN {book} c ON c.part = v.part GROUP BY v.rid, v.part, v.x"""
_MEANS = """SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM {book} c LEFT JOIN (
          SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
            SELECT part, entry, i, sum(y) AS s, count(*) AS n FROM (
              SELECT part, m.e AS entry, unnest(range(len(x))) AS i, unnest(x) AS y FROM {near}) u GROUP BY part, entry, i) t
          GROUP BY part, entry) n ON n.part = c.part AND n.entry = c.entry"""

VECTOR_CODES = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS f
       FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  v AS MATERIALIZED (SELECT rid, part, f[part * (len(f) // 16) + 1:(part + 1) * (len(f) // 16)] AS x
       FROM (SELECT rid, f, unnest(range(16)) AS part FROM k) u),
  c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM v WHERE rid <= 64),
  n0 AS MATERIALIZED ({_NEAREST.format(book='c0')}),
  c1 AS MATERIALIZED ({_MEANS.format(book='c0', near='n0')}),
  n1 AS MATERIALIZED ({_NEAREST.format(book='c1')}),
  c2 AS MATERIALIZED ({_MEANS.format(book='c1', near='n1')}),
  n2 AS MATERIALIZED ({_NEAREST.format(book='c2')}),
  r AS (SELECT rid, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n2 GROUP BY rid),
  h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM r JOIN k ON k.rid = r.rid, h"""

PHRASES = f"""
WITH q AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
  z AS MATERIALIZED (SELECT row_number() OVER () AS rid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
       FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM q) x),
  s AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM z GROUP BY lang),
  g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM z, range(1, 6) r(k) WHERE len(ws) >= k) y),
  f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
  c AS (SELECT lang, phrase, ws, a, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k >= 2),
  m AS (SELECT c.lang, c.phrase, c.a, min(struct_pack(score := (1000 * c.a * s.n) // (x.a * y.a), cut := cut, l := x.a, r := y.a)) AS b, any_value(s.n) AS n
        FROM c JOIN s ON s.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ') GROUP BY c.lang, c.phrase, c.a),
  p AS (SELECT lang, a, array_to_string(ws[i:i + w - 1], ' ') AS part
        FROM (SELECT lang, a, ws, w, unnest(generate_series(1, len(ws) - w + 1)) AS i FROM f, range(2, 5) r(w) WHERE len(ws) > w) y),
  o AS (SELECT lang, part, max(a) AS a FROM p GROUP BY lang, part),
  k AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY b.score DESC, m.a DESC, m.phrase) AS rank
        FROM m LEFT JOIN o ON o.lang = m.lang AND o.part = m.phrase WHERE o.a IS NULL OR 100 * o.a < 100 * m.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(b.l AS BIGINT) AS l, CAST(b.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(b.score AS BIGINT) AS score FROM k WHERE rank <= 2000"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  g AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x,
          row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS nth,
          first_value(page_id) OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS top FROM p),
  d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM g)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN top END AS refers_to FROM d"""

ORACLES = {
    "op2_shingle_jaccard_join": JACCARD,
    "op4_host_quality_rules": QUALITY_RULES,
    "op5_wu_manber_decontamination": DECONTAMINATION,
    "op7_mix_sources": MIX,
    "op9_sparse_suffix_dedup": REPEATS,
    "op11_phrase_mining": PHRASES,
    "op12_vector_codes": VECTOR_CODES,
    "op13_warc_packages": WARC,
}
