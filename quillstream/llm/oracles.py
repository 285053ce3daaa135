"""SQL of the numbered operators whose results SQL can express exactly."""

from __future__ import annotations

from quillstream.llm import licenses, urlfilter

#: Words without ASCII blanks, as a list.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = f"""
WITH texts AS (
  SELECT DISTINCT doc_id, text FROM documents
), split AS (
  SELECT doc_id, text, {_WORDS.format("text")} AS w FROM texts
), places AS (
  SELECT doc_id, text, w, unnest(generate_series(1, len(w) - 49)) AS p FROM split WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, md5(text) AS text_key, p - 1 AS start, p + 49 AS stop, md5(array_to_string(w[p : p + 49], ' ')) AS digest FROM places
), shared AS (
  SELECT digest, min(doc_id) AS low FROM windows GROUP BY digest HAVING min(doc_id) < max(doc_id)
), found AS (
  SELECT doc_id, text_key, start, stop, doc_id > low AS again FROM windows JOIN shared USING (digest)
), fresh AS (
  SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id, text_key, again ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM found
), islands AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, text_key, again ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM fresh
)
SELECT doc_id, min(start)::BIGINT AS start_word, max(stop)::BIGINT AS end_word, (max(stop) - min(start))::BIGINT AS n_words, NOT again AS "first"
FROM islands GROUP BY doc_id, text_key, again, island
"""

OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), filled AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns
), written AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|><|im_sep|><|im_end|>') AS chars FROM filled
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

OP10 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
  )
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a
), named AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM documents JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

#: A-Z alone, lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The checksum's table follows from its polynomial; a letter up to U+00FF is one or two bytes.
OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT concat(doc_id, ':') AS head, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents
), distinct_runs AS (
  SELECT head, run, count(*) AS n, list_transform(string_split(head || run, ''), lambda x: unicode(x)::BIGINT) AS points FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END)) AS b FROM distinct_runs
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary
), cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM places
), near AS (
  SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocabulary v ON c.rest = v.word
  UNION ALL SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocabulary v ON c.rest = v.word
), best AS (
  SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -n_b, form := b)) FILTER (n_b >= 2 * n_a) AS best FROM near GROUP BY a
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, best.form AS form, -best.less AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), paths AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON p.at = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT p.word, p.at AS root FROM paths p JOIN formed f ON p.at = f.word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN roots USING (word)
"""

OP13 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS length, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split
), f AS (
  SELECT lang, phrase, length, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE length = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, length, f AS a FROM f WHERE length >= 2 AND f >= 10
), halves AS (
  SELECT lang, phrase, a, length, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : length], ' ') AS tail
  FROM candidates, (VALUES (1), (2)) cut(k) WHERE k < length
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.length, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM halves c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS holder
  FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE length = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE length = 3) GROUP BY ALL
), kept AS (
  SELECT lang, phrase, a, l, r, score FROM weakest LEFT JOIN held USING (lang, phrase) WHERE length = 3 OR holder IS NULL OR 100 * holder < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1, "op2_chat": OP2, "op7_urls": urlfilter.ORACLE, "op10_neardup": OP10, "op11_spelling": OP11, "op12_licenses": licenses.ORACLE, "op13_phrases": OP13}
