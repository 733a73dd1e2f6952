"""The queries of this subpackage, by name, and SQL where SQL can express one."""

from __future__ import annotations

from descra.llm.arrow_files import op3_arrow_token_files
from descra.llm.chat import op8_incremental_chat_formatting
from descra.llm.decontaminate import op7_benchmark_decontamination
from descra.llm.embeddings import op2_pca_tiled_embedding_dedup
from descra.llm.html_template import op9_template_html_extraction
from descra.llm.jaccard import op10_token_group_jaccard_join
from descra.llm.line_dedup import op6_line_chunk_dedup
from descra.llm.packing import op4_best_fit_packing
from descra.llm.token_counts import op1_section_token_counts
from descra.llm.toxicity import op5_boosted_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_section_token_counts,
        op2_pca_tiled_embedding_dedup,
        op3_arrow_token_files,
        op4_best_fit_packing,
        op5_boosted_toxicity,
        op6_line_chunk_dedup,
        op7_benchmark_decontamination,
        op8_incremental_chat_formatting,
        op9_template_html_extraction,
        op10_token_group_jaccard_join,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """r AS (SELECT id AS node, id AS reach FROM n UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach),
 c AS (SELECT node AS id, min(reach) AS component_id FROM r GROUP BY 1)"""
_SAID = "'\\### Assistant: </turn> ok'"

#: DuckDB SQL; the other operators need a tokenizer, a trained model or a parser.
SQL: dict[str, str] = {
    "op2_pca_tiled_embedding_dedup": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
 e AS (SELECT a.id AS x, b.id AS y FROM n a JOIN n b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.98), {_REACH}
 SELECT n.id AS vec_id, (SELECT count(*) FROM e WHERE e.x = n.id) AS n_links, component_id, n.id = component_id AS kept FROM n JOIN c ON c.id = n.id""",
    "op7_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i+12], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
 dw AS (SELECT doc_id, i, l, array_to_string(w[i:i+l-1], ' ') AS win FROM d, (SELECT DISTINCT l FROM bw) k, unnest(range(1, len(w) - l + 2)) t(i)),
 h AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON bw.l = dw.l AND bw.win = dw.win),
 p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p FROM h, unnest(range(i, i + l)) t(p)) GROUP BY 1),
 s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id""",
    "op8_incremental_chat_formatting": f"""WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(len(role) + 15 + len(regexp_replace(text, '(\\\\|###|</turn>)', '\\\\\\1', 'g')))::BIGINT AS formatted_chars FROM t GROUP BY 1""",
    "op10_token_group_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT id, array_to_string(w[i:i+2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
 n AS (SELECT d.id, count(g) AS k FROM d LEFT JOIN s ON s.id = d.id GROUP BY 1),
 p AS (SELECT a.id AS x, b.id AS y, count(*) AS share FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE 100 * share >= 90 * (a.k + b.k - share)), {_REACH}
 SELECT n.id AS doc_id, k AS n_shingles, component_id FROM n JOIN c ON c.id = n.id""",
}
