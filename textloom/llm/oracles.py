"""SQL for the operators that SQL can express, without any of their filters."""

from __future__ import annotations

from . import license

GROUPS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT r.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id, n.n"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, min(r.root) AS component_id, min(r.root) = r.id AS kept FROM r LEFT JOIN n ON n.a = r.id GROUP BY r.id, n.n"""


def chat() -> str:
    from .chat import CONTROLS, END, TEXT, TURN

    def escaped(col: str) -> str:
        out = f"replace(coalesce({col}, ''), '\\', '\\\\')"
        for c in CONTROLS:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    fixed = len(TURN) + len(TEXT) + len(END)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum({fixed} + length({escaped("role")}) + length({escaped("text")})) AS size FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op4_pstable_neighbours": VECTORS, "op5_ngram_jaccard_join": GROUPS, "op8_chat_parts": chat(), "op10_license_scan": license.oracle()}
