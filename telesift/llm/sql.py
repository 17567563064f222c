"""SQL for the queries whose answer SQL can give."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"SELECT doc_id, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents"


def _components(links: str, ids: str) -> str:
    """reach(id, root): everything that can be reached over the links (a, b)."""
    return f"both_ways AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}), reach(id, root) AS (SELECT {ids} UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.root = both_ways.a)"


_ESCAPED = "regexp_replace({x}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, sum(length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")}) + 23) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(upto) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars,
 count(*) FILTER (role = 'assistant' OR back = 1) AS n_examples FROM s GROUP BY conv_id"""

SUBSTRINGS = f"""WITH t AS ({_words("coalesce(text, '')")}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + o.o AS i FROM g JOIN f USING (g), range(0, 50) o(o) WHERE m < doc_id),
p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
{_components("l", "vec_id, vec_id FROM v")}, c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id), d AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN d ON d.a = v.vec_id"""

NEAR_DUPLICATES = f"""WITH RECURSIVE t AS ({_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")}),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t)),
n AS (SELECT t.doc_id, count(s) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_components("l", "doc_id, doc_id FROM t")}, c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, component_id, component_id = n.doc_id AS kept FROM n JOIN c ON c.id = n.doc_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLE = {"op3_chat": CHAT, "op4_substrings": SUBSTRINGS, "op5_embeddings": EMBEDDINGS, "op6_neardup": NEAR_DUPLICATES, "op10_topk": TOP_K}
