"""SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"


OP3 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_words("text")} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
texts AS (SELECT DISTINCT w FROM d),
spot AS (
  SELECT w, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM texts, (SELECT DISTINCT k FROM win), unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)),
hit AS MATERIALIZED (SELECT w, i, spot.k, item_id FROM spot JOIN win ON spot.k = win.k AND spot.s = win.s),
n AS (SELECT w, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, k)) AS t(j) GROUP BY w),
m AS (SELECT w, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY w)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON d.w = n.w LEFT JOIN m ON d.w = m.w
"""

OP11 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
r AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
             max(page_id) OVER (PARTITION BY payload) AS best FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
FROM r
"""

# CRC-32 of the bytes of "<id>:<run>": a table of 256 steps of the polynomial, then one look-up a byte.
OP12 = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)
         ORDER BY b) AS steps FROM range(0, 256) AS t(b)),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
         lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS b FROM runs),
hashed AS (
  SELECT doc_id, run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))),
         lambda h, x: xor(steps[CAST(xor(h % 256, x) AS INTEGER) + 1], h // 256)), 4294967295) AS h FROM bytes, crc),
written AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2)
         ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM words, unnest(range(0, length(word))) AS t(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON b.rest = a.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(near, (-n, near)) AS best FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
         CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms last ON c.root = last.word WHERE last.form IS NULL
"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return f"unnest(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERMS}'))"


OP13 = f"""
WITH t AS MATERIALIZED (SELECT doc_id, {_terms("text")} AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM d, total),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {_terms("text")} AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3,
    "op7_exact_dedup": OP7,
    "op11_warc": OP11,
    "op12_spelling": OP12,
    "op13_lexical_search": OP13,
}
