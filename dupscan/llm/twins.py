"""DuckDB SQL for the rows of those queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
steps AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS state,
    5 + length(role) + length(role) - length(regexp_replace(role, '[\\<|\[\]]', '', 'g'))
      + length(text) + length(text) - length(regexp_replace(text, '[\\<|\[\]]', '', 'g')) + 8 AS chars
  FROM own),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned, sum(chars)::BIGINT AS formatted_chars,
    bool_and((state, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'),
      ('assistant', 'tool'), ('tool', 'assistant'), ('tool', 'tool'))) AS valid
  FROM steps GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, valid FROM joined
"""

REACH = """joined AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, joined.b FROM reach JOIN joined ON reach.r = joined.a)"""

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS k FROM documents),
nodes AS (SELECT id, CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 4 THEN [array_to_string(k, ' ')]
  ELSE list_distinct(list_transform(range(0, len(k) - 3), lambda i: array_to_string(k[i + 1:i + 4], ' '))) END AS g FROM w),
flat AS (SELECT id, unnest(g) AS g FROM nodes),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * c >= 85 * (len(x.g) + len(y.g) - c)),
{REACH}
SELECT n.id AS doc_id, len(any_value(g))::BIGINT AS n_shingles, min(r) AS component_id FROM nodes n JOIN reach USING (id) GROUP BY n.id
"""

OP5 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
fine AS (SELECT * FROM nodes WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.id < y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.98),
{REACH},
counted AS (SELECT a, count(*) AS n FROM joined GROUP BY a),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, id = c AS kept FROM least LEFT JOIN counted ON a = id
"""

OP7 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS k FROM documents),
wins AS (SELECT doc_id, unnest(range(0, len(k) - 49)) AS pos, unnest(list_transform(range(0, len(k) - 49), lambda i: md5(array_to_string(k[i + 1:i + 50], ' ')))) AS sig FROM w WHERE len(k) >= 50),
owner AS (SELECT sig, min(doc_id) AS least FROM wins GROUP BY sig),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos + 1, pos + 51)) AS i FROM wins JOIN owner USING (sig) WHERE least < doc_id),
flat AS (SELECT doc_id, unnest(k) AS word, generate_subscripts(k, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(k)::BIGINT AS n_words, len(k) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
