"""SQL for DuckDB that states the results of the license scan, the spelling variants and the vector codes."""

from __future__ import annotations

from .licenses import NOTICES, PHRASES, SHARE, notices
from .spelling import DOMINANCE, ERRATA, LEAST_COUNT, LEAST_LENGTH
from .vectors import ENTRIES, PARTS, ROUNDS, SCALE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


def licenses() -> str:
    """Every word of every text is joined with the words of the notices; blocks are counted without any filter."""
    found = notices(NOTICES)
    members = [(k, w.decode(), int(w in x.needs)) for k, x in enumerate(found) for w in x.words]
    heads = [(k, x.label, x.width, len(x.words), len(x.needs)) for k, x in enumerate(found)]
    phrases = [(p, i, w, label, len(p.split())) for p, label in PHRASES.items() for i, w in enumerate(p.split())]
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
places AS (
  SELECT row, pos - i AS place, label FROM words JOIN {_values(phrases)} p(phrase, i, word, label, n) USING (word) WHERE pos >= i GROUP BY row, place, phrase, label, n HAVING count(*) = n),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY row),
blocks AS (
  SELECT row, notice, label, width, block, count(DISTINCT word) / m::DOUBLE AS share FROM (
    SELECT row, word, notice, needed, unnest(CASE WHEN pos // width > 0 THEN [pos // width - 1, pos // width] ELSE [0] END) AS block, label, width, m, needs
    FROM words JOIN {_values(members)} t(notice, word, needed) USING (word) JOIN {_values(heads)} h(notice, label, width, m, needs) USING (notice))
  GROUP BY row, notice, label, width, block, m, needs HAVING 100 * count(DISTINCT word) >= {SHARE} * m AND count(DISTINCT word) FILTER (needed = 1) = needs),
best AS (SELECT row, list(DISTINCT label) AS own, max(share) AS share FROM (SELECT *, max(share) OVER (PARTITION BY row, width, block) AS most FROM blocks) WHERE share = most GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN best USING (row)
"""


#: A checksum is the exclusive or of what each byte leaves after those behind it (``remainder``) and of what an empty register
#: leaves; near words are those that share a string with one code point left out, at the same place or of the longer one.
SPELLING = f"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
keyed AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs),
shift(i, b, v) AS (SELECT 0, b, b FROM range(0, 256) t(b) UNION ALL SELECT i + 1, b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM shift WHERE i < 8),
step AS (SELECT b, v::BIGINT AS t FROM shift WHERE i = 8),
remainder(k, b, v) AS (SELECT 0::BIGINT, b, t FROM step UNION ALL SELECT k + 1, r.b, xor(r.v // 256, t) FROM remainder r JOIN step s ON s.b = r.v % 256 WHERE k < (SELECT max(len(h)) // 2 FROM keyed)),
register(k, v) AS (SELECT 0::BIGINT, 4294967295::BIGINT UNION ALL SELECT k + 1, xor(v // 256, t) FROM register JOIN step ON b = v % 256 WHERE k < (SELECT max(len(h)) // 2 FROM keyed)),
bytes AS (SELECT h, len(h) // 2 AS size, unnest(range(0, len(h) // 2)) AS i FROM (SELECT DISTINCT h FROM keyed)),
sums AS (SELECT h, size, bit_xor(r.v) AS v FROM bytes JOIN remainder r ON r.k = size - 1 - i AND r.b = ('0x' || substr(h, 2 * i + 1, 2))::BIGINT GROUP BY h, size),
checks AS (SELECT h, xor(xor(s.v, r.v), 4294967295) AS crc FROM sums s JOIN register r ON r.k = size),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN crc % {ERRATA} = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word FROM keyed JOIN checks USING (h))
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, min(other) FILTER (n = top) AS other FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {DOMINANCE} * n THEN other END AS form, CASE WHEN most >= {DOMINANCE} * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
path(word, root, i) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT p.word, f.form, i + 1 FROM path p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN (SELECT word, arg_max(root, i) AS root FROM path GROUP BY word) USING (word)
"""


def vector_codes() -> str:
    """Every part is compared with every entry, in one pair of expressions for each round."""
    width = f"(SELECT len(x) // {PARTS} FROM whole LIMIT 1)"
    rounds, book = [], "book0"
    for k in range(ROUNDS + 1):
        rounds.append(f"""
dist{k} AS MATERIALIZED (SELECT row, p, e, sum((a.v - b.v) * (a.v - b.v))::BIGINT AS d FROM part a JOIN {book} b USING (p, j) GROUP BY row, p, e),
near{k} AS MATERIALIZED (SELECT row, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM dist{k} GROUP BY row, p)""")
        if k < ROUNDS:
            rounds.append(f"""
mean{k} AS (SELECT p, e, j, sum(v) AS s, count(*) AS n FROM part JOIN near{k} USING (row, p) GROUP BY p, e, j),
book{k + 1} AS MATERIALIZED (SELECT p, e, j, CASE WHEN s IS NULL THEN v ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS v FROM {book} LEFT JOIN mean{k} USING (p, e, j))""")
            book = f"book{k + 1}"
    return f"""
WITH good AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
whole AS MATERIALIZED (SELECT * FROM good WHERE len(x) = (SELECT len(x) FROM good GROUP BY len(x) ORDER BY count(*) DESC, len(x) LIMIT 1)),
part AS MATERIALIZED (SELECT row, pos // {width} AS p, pos % {width} AS j, v FROM (SELECT row, unnest(x) AS v, unnest(range(0, len(x))) AS pos FROM whole)),
seed AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM whole),
book0 AS MATERIALIZED (SELECT p, e, j, v FROM part JOIN seed USING (row) WHERE e < {ENTRIES}),{",".join(rounds)},
coded AS (SELECT vec_id, label, code, error FROM whole JOIN (SELECT row, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row) USING (row))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM {book}) AS codebooks_sha256 FROM coded
"""
