"""DuckDB SQL of the training-data queries that SQL can express."""

# CRC-32 of the UTF-8 bytes of '<doc_id>:<run>' bit by bit; near words by the
# strings that one left-out code point gives.
SPELLING = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(t, '[a-z\x{C0}-\x{FF}]+')) AS run FROM lowered
),
counted AS (
  SELECT id || ':' || run AS named, run, count(*) AS n FROM run WHERE length(run) >= 5 GROUP BY ALL
),
bytes AS (
  SELECT run, n, list_transform(range(1, strlen(named) + 1),
                                lambda i: CAST('0x' || hex(encode(named))[2 * i - 1:2 * i] AS UBIGINT)) AS b FROM counted
),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), b),
    lambda c, x: list_reduce(
      list_prepend(xor(c, x), [CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]),
      lambda d, y: xor(d >> 1, CAST(3988292384 AS UBIGINT) * (d & 1))))) AS h
  FROM bytes
),
word AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word,
         n FROM hashed
),
dict AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM dict)
),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN dict b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN dict b ON a.rest = b.word
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pair
),
linked AS (
  SELECT d.word, d.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.near_n >= 2 * d.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * d.n THEN r.near_n END AS form_n
  FROM dict d LEFT JOIN ranked r ON r.word = d.word AND r.place = 1
),
walk AS (
  SELECT word, form AS here, 1 AS steps FROM linked WHERE form IS NOT NULL
  UNION ALL
  SELECT w.word, l.form, w.steps + 1 FROM walk w JOIN linked l ON l.word = w.here WHERE l.form IS NOT NULL
),
ends AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT l.word, l.form, coalesce(e.root, l.word) AS root, l.n, l.n_near, l.form_n
FROM linked l LEFT JOIN ends e ON e.word = l.word
"""

# All phrases of one to three words are counted; no phrase is proposed.
COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM place, (VALUES (1), (2), (3)) AS size(k) WHERE i + k - 1 <= len(w)
),
f AS (SELECT lang, k, phrase, count(*) AS n FROM gram GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
part AS (
  SELECT cut.lang, cut.k, cut.phrase, a, w, c, x.n AS l, y.n AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cut
  JOIN f x ON x.lang = cut.lang AND x.k = c AND x.phrase = array_to_string(w[1:c], ' ')
  JOIN f y ON y.lang = cut.lang AND y.k = cut.k - c AND y.phrase = array_to_string(w[c + 1:], ' ')
),
lowest AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, sub, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS sub FROM cand WHERE k = 3) GROUP BY ALL
)
SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY p.score DESC, p.a DESC, p.phrase) AS rank,
       p.phrase, p.a, p.l, p.r, total.n, p.score
FROM lowest p JOIN total ON total.lang = p.lang LEFT JOIN inside i ON i.lang = p.lang AND i.sub = p.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 50 * p.a
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op12_spelling": SPELLING,
    "op13_collocations": COLLOCATIONS,
}
