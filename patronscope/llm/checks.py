"""DuckDB SQL for the queries that SQL can express, on the same Parquet tables."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of the SQL expression ``text``, bit by bit."""
    digits = f"hex(encode({text}))"
    nibble = "instr('123456789ABCDEF', substr({0}, 2 * i + {1}, 1))"
    bytes_ = (
        f"list_transform(range(0, length({digits}) // 2), lambda i: CAST("
        f"{nibble.format(digits, 1)} * 16 + {nibble.format(digits, 2)} AS BIGINT))"
    )
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda acc, b:"
        f" list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, k: {bit})), 4294967295)"
    )


CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT i.conv_id, t.place, t.role, t.text FROM ids i
  JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.place < i.h
  UNION ALL
  SELECT i.conv_id, t.place, t.role, t.text FROM ids i
  JOIN turns t ON t.conv_id = i.conv_id AND t.place >= i.h
), paths AS (
  SELECT conv_id, '' AS node, 0 AS depth, 0 AS chars FROM ids
  UNION ALL
  SELECT conv_id,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
      OVER (PARTITION BY conv_id ORDER BY place),
    row_number() OVER (PARTITION BY conv_id ORDER BY place), length(text)
  FROM rebuilt
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
    depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM paths
), nodes AS (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id,
    count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '') AS ends
  FROM linked GROUP BY node
), sized AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.above = n.node) AS n_children FROM nodes n
), under AS (
  SELECT DISTINCT a.node, b.node AS below FROM paths a
  JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), totals AS (
  SELECT u.node, sum(s.saved) AS saved_tokens, count(*) FILTER (s.n_children = 0) AS n_leaves
  FROM under u JOIN sized s ON s.node = u.below GROUP BY u.node
)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id,
  CAST(s.n_convs AS BIGINT) AS n_convs, CAST(s.n_children AS BIGINT) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(s.ends) AS ends_sha256
FROM sized s JOIN totals t USING (node) LEFT JOIN sized p ON p.node = s.above
"""


NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS shared FROM shingles x
        JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes a ON a.doc_id = p JOIN sizes b ON b.doc_id = q
  WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), reached AS (
  SELECT doc_id AS node, doc_id AS low FROM sizes
  UNION
  SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.node WHERE r.low < l.b
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT node, min(low) AS low FROM reached GROUP BY node) c ON c.node = w.doc_id
"""

SUFFIX_DEDUP = """
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS piece
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM hexed)
), again AS (
  SELECT doc_id, p FROM starts
  QUALIFY row_number() OVER (PARTITION BY piece ORDER BY doc_id, p) > 1
), marked AS (
  SELECT doc_id, p,
    sum(CASE WHEN p - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)
), spans AS (
  SELECT doc_id, min(p) AS low, max(p) + 100 AS high FROM marked GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, low, high,
    coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans
  UNION ALL
  SELECT doc_id, length(h) // 2, length(h) // 2, coalesce((SELECT max(high) FROM spans s
    WHERE s.doc_id = x.doc_id), 0) FROM hexed x
)
SELECT x.doc_id, any_value(length(x.h) // 2) AS n_bytes,
  CAST(sum(k.high - k.low) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(substr(x.h, 2 * k.since + 1, 2 * (k.low - k.since)), ''
    ORDER BY k.low, k.high))) AS kept_sha256
FROM hexed x JOIN kept k USING (doc_id) GROUP BY x.doc_id
"""


LINE_DEDUP = """
WITH split AS (
  SELECT doc_id, ends_with(text, chr(10)) AS broken, string_split(
    CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l
  FROM documents WHERE text <> ''
), lines AS (
  SELECT doc_id, broken, len(l) AS m, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM split
), runs AS (
  SELECT doc_id, k, least(m, 2) AS n, CASE WHEN m = 1 THEN line
    ELSE line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) END AS run FROM lines
), gone AS (
  SELECT DISTINCT doc_id, k + unnest(range(0, n)) AS k
  FROM (SELECT doc_id, k, n, first_value(doc_id) OVER w AS first_doc, first_value(k) OVER w AS first_k
        FROM runs WHERE run IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY doc_id, k))
  WHERE doc_id <> first_doc OR k >= first_k + n
), told AS (
  SELECT l.doc_id, l.k, g.k IS NOT NULL AS out,
    CASE WHEN g.k IS NULL THEN line || CASE WHEN l.k < m OR broken THEN chr(10) ELSE '' END
      ELSE '' END AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k
), marked AS (
  SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY k), false) AS begins
  FROM told
), left_over AS (
  SELECT doc_id, count(*) FILTER (begins) AS removed_chunks, count(*) FILTER (out) AS removed_lines,
    string_agg(kept, '' ORDER BY k) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(o.removed_chunks, 0) AS removed_chunks,
  coalesce(o.removed_lines, 0) AS removed_lines, strlen(coalesce(o.kept, '')) AS kept_bytes,
  sha256(coalesce(o.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""


SPELLING = f"""
WITH runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS (
  SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run)
), altered AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) ||
    substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), blanked AS (
  SELECT word, n, i, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS pattern FROM places
), cut AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM places
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM blanked a JOIN blanked b ON a.pattern = b.pattern AND a.word <> b.word
  UNION ALL
  SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.shorter
  UNION ALL
  SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.shorter
), ranked AS (
  SELECT word, other AS form, other_n AS form_n,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place,
    count(*) OVER (PARTITION BY word) AS n_near
  FROM near
), joined AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
    CASE WHEN r.form_n >= 10 * w.n THEN r.form END AS form,
    CASE WHEN r.form_n >= 10 * w.n THEN r.form_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chains AS (
  WITH RECURSIVE steps AS (
    SELECT word, form AS at FROM joined WHERE form IS NOT NULL
    UNION ALL
    SELECT s.word, j.form FROM steps s JOIN joined j ON j.word = s.at WHERE j.form IS NOT NULL
  )
  SELECT s.word, s.at AS root FROM steps s JOIN joined j ON j.word = s.at AND j.form IS NULL
)
SELECT j.word, j.form, coalesce(c.root, j.word) AS root, j.n, CAST(j.n_near AS BIGINT) AS n_near,
  j.form_n
FROM joined j LEFT JOIN chains c ON c.word = j.word
"""


def all_checks() -> dict[str, str]:
    return {
        "op5_line_dedup": LINE_DEDUP,
        "op6_suffix_dedup": SUFFIX_DEDUP,
        "op10_near_duplicates": NEAR_DUPLICATES,
        "op11_conversation_trie": CONVERSATION_TRIE,
        "op12_spelling": SPELLING,
    }
