"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

#: 13-word windows as joined words; the first document of each keeps it.
REPEATED_PASSAGES = r"""WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs
), windows AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER s AS k, count(*) OVER s AS n FROM words
  WINDOW s AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), firsts AS (
  SELECT k, min(doc_id) AS first_id FROM windows WHERE n = 13 GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p
  FROM windows JOIN firsts USING (k) WHERE n = 13 AND first_id < doc_id
), judged AS (
  SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS dropped
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE dropped) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT dropped) AS rest
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Classes of equal sets, their links by counted common shingles, and who reaches whom.
SET_LINKS = r"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, len(w) AS n_words, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs
), runs AS (
  SELECT doc_id, p, n_words, string_agg(word, ' ') OVER s AS shingle, count(*) OVER s AS n FROM words
  WINDOW s AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM runs WHERE n = 4 OR (n_words < 4 AND p = 0)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS signature FROM shingles GROUP BY doc_id
), classes AS (
  SELECT signature, n, min(doc_id) AS rep FROM sets GROUP BY signature, n
), members AS (
  SELECT rep, n, shingle FROM classes JOIN shingles ON rep = doc_id
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT rep AS node, rep AS other FROM classes
  UNION
  SELECT node, b FROM reached JOIN links ON other = a
), components AS (
  SELECT node, min(other) AS component FROM reached GROUP BY node
)
SELECT docs.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(component, docs.doc_id) AS component_id
FROM docs LEFT JOIN sets ON docs.doc_id = sets.doc_id
LEFT JOIN classes ON sets.signature = classes.signature LEFT JOIN components ON classes.rep = node
"""

#: What the formatted conversations hold, from their rows; lengths follow the template.
CONVERSATIONS = r"""WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) said(t, r)
), sized AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) AS role_chars,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) AS text_chars
  FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<s>[') + role_chars + length(']') + 1 + text_chars + length('</s>') + 1) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

BY_QUERY: dict[str, str] = {
    "op3_substring_dedup": REPEATED_PASSAGES,
    "op4_ngram_jaccard_join": SET_LINKS,
    "op7_chat_formatting": CONVERSATIONS,
}
