"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
CHARS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT *, translate(trim(line, {CHARS}), {AZ}) AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""

_LOUD = r"[!?#*$%&|<>{}~^=_\\]"
_STOCK = (
    r"(?i)\b((cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|sign up|log in|subscribe now|lorem ipsum|"
    r"datenschutzerkl[äÄ]rung|cookie-richtlinie|nutzungsbedingungen|alle rechte vorbehalten|javascript aktivieren|hier klicken|jetzt (anmelden|abonnieren|registrieren)|impressum|"
    r"politique de cookies|mentions l[éÉ]gales|conditions d.utilisation|tous droits r[éÉ]serv[éÉ]s|activer javascript|cliquez ici|se connecter|abonnez-vous|"
    r"pol[íÍ]tica de (cookies|privacidad)|aviso legal|t[éÉ]rminos (de uso|y condiciones)|todos los derechos reservados|activar javascript|(haz|haga) clic|iniciar sesi[óÓ]n|suscr[íÍ]bete)\b|politique de confidentialit)"
)
OP2 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l, i, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(l, '{_LOUD}')) AS loud, len(regexp_extract_all(l, '[|»›•]')) AS sep, len(regexp_extract_all(l, '{_STOCK}')) AS stock FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM w)),
near AS (SELECT *, coalesce(lag(n) OVER o BETWEEN 1 AND 4, false) OR coalesce(lead(n) OVER o BETWEEN 1 AND 4, false) AS menu, i <= 2 OR i > count(*) OVER (PARTITION BY doc_id) - 2 AS edge FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
told AS (SELECT *, n <= 25 AND stock > 0 AND (CASE WHEN n <= 6 THEN 2 ELSE 0 END) + edge::INT + menu::INT + (NOT regexp_matches(l, '[.!?…:;)"»”]\s*$'))::INT + (stock >= 2)::INT >= 2 AS boiler FROM near),
lost AS (SELECT doc_id, sum(CASE WHEN (loud >= 4 AND loud * 10 > n * 3) OR (sep >= 3 AND sep * 5 > n) OR boiler THEN length(regexp_replace(l, '{SPACE}', '', 'g')) ELSE 0 END) AS chars FROM told GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(ls, lambda x: trim(x, {CHARS}) <> '')) - len(list_distinct(list_filter(ls, lambda x: trim(x, {CHARS}) <> ''))) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, lost.chars
  FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id JOIN lost ON w.doc_id = lost.doc_id
), j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (100 * chars > 50 * word_chars) AS kept FROM j
"""

OP5 = f"""
WITH sized AS (SELECT doc_id, source, length(coalesce(text, '')) AS chars, len({WORDS})::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
ranked AS (SELECT *, cap / weight AS ratio, sum(cap) OVER w AS caps, sum(weight) OVER w AS weights FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, ((SELECT sum(source_size) FROM src) * 1.5::DOUBLE - coalesce(caps, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(weights, 0)) AS level FROM ranked),
fit AS (SELECT min_by(level, (ratio, source)) AS fits FROM levels WHERE level <= ratio),
goal AS (SELECT source, source_size, CASE WHEN fits IS NULL OR ratio < fits THEN cap ELSE fits * weight END AS target FROM levels, fit),
keyed AS (SELECT s.*, g.source_size, g.target, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) /
    (CASE WHEN size > 0 THEN 0.25::DOUBLE + 0.75::DOUBLE * least(chars::DOUBLE / greatest(size, 1) / 6.0::DOUBLE, 6.0::DOUBLE / greatest(chars::DOUBLE / greatest(size, 1), 0.5::DOUBLE)) ELSE 0.25 END) AS key
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
summed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM keyed)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(floor(target) - epochs * source_size - before, 0), size))::BIGINT AS taken FROM summed
"""

_ITEM = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_ITEM} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS span FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_ITEM} AS ws FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS span FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
h AS (SELECT dw.doc_id, dw.size, dw.i, bw.item FROM dw JOIN bw ON dw.size = bw.size AND dw.span = bw.span),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS text, count(*) AS n FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_ESC = "replace(replace(replace({}, '~', '~0'), '<', '~1'), '[', '~2')"
OP10 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NULL AS r0, text IS NULL AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', false, false UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', false, false
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, NOT r0, role, NOT t0, text) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length({_ESC.format('role')}) + length({_ESC.format('text')}))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""



def _op12(rounds: int = 6) -> str:
    """Rounds of assigning and averaging, written out one after another."""
    near = "SELECT v.k, v.part, v.p, min({ 'd': list_sum(list_transform(list_zip(v.p, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.entry }) AS best FROM v JOIN b{r} b ON v.part = b.part GROUP BY v.k, v.part, v.p"
    mean = (
        "SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY d) AS c FROM "
        "(SELECT part, best.e AS entry, d, sum(p[d])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, 9)) AS d FROM a{r}) GROUP BY ALL) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry"
    )
    steps = [
        "WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS k, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true))",
        "v AS MATERIALIZED (SELECT k, part, x[part * 8 + 1:part * 8 + 8] AS p FROM (SELECT *, unnest(range(0, 8)) AS part FROM kept))",
        "b0 AS MATERIALIZED (SELECT part, k - 1 AS entry, p AS c FROM v WHERE k <= 16)",
    ]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({near.replace('{r}', str(r))})", f"b{r + 1} AS MATERIALIZED ({mean.replace('{r}', str(r))})"]
    steps += [
        f"a AS MATERIALIZED ({near.replace('{r}', str(rounds))})",
        "coded AS (SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a GROUP BY k)",
        f"told AS (SELECT sha256(string_agg(c[d]::VARCHAR, ',' ORDER BY part, entry, d)) AS codebooks_sha256 FROM (SELECT *, unnest(range(1, 9)) AS d FROM b{rounds}))",
    ]
    return ", ".join(steps) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (k), told"


OP12 = _op12()

#: CRC-32 by its definition, eight steps a byte, over the distinct features.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP13 = rf"""
WITH RECURSIVE bytes(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {_STEP} FROM bytes WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bytes WHERE k = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, {_ITEM} AS ws FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, {_ITEM} FROM benchmark),
found AS MATERIALIZED (SELECT side, row, array_to_string(ws[i:i + n - 1], ' ') AS f FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS n FROM texts))),
named AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM found), crcs),
placed AS MATERIALIZED (SELECT side, row, bucket FROM found JOIN named USING (f)),
sums AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT t0.s FROM sums t0) + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * ((SELECT t0.t FROM sums t0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket)),
weighed AS (SELECT row, count(*) AS n_features, sum(gain) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (row) WHERE side = 'd'),
drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM drawn
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op2_quality_rules": OP2, "op5_mixing": OP5, "op6_decontamination": OP6, "op9_substring_dedup": OP9, "op10_chat_format": OP10, "op12_vector_codes": OP12, "op13_resampling": OP13}
