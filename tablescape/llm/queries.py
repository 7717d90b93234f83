"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescape.llm import ann, decontamination, dsir, fim, licenses, lm, mixing, quality, sharding, simhash, tokencount, tokenids, topk
from tablescape.llm.common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


ALL = {
    "op1_lm_scoring": lambda s, d: lm.op1_lm_scores(table(s, d, "documents"), vocabulary("word_bpe_49k.json")),
    "op2_token_counts": lambda s, d: tokencount.op2_token_counts(table(s, d, "documents"), vocabulary("byte_bpe_50k.json")),
    "op3_simhash": lambda s, d: simhash.op3_simhash(table(s, d, "documents")),
    "op4_licenses": lambda s, d: licenses.op4_licenses(table(s, d, "documents")),
    "op5_exact_top_k": lambda s, d: topk.op5_top_k(table(s, d, "embeddings")),
    "op6_mixing": lambda s, d: mixing.op6_mix(table(s, d, "documents")),
    "op7_decontamination": lambda s, d: decontamination.op7_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
    "op8_sharding": lambda s, d: sharding.op8_shard(table(s, d, "documents")),
    "op9_token_ids": lambda s, d: tokenids.op9_token_ids(table(s, d, "documents"), vocabulary("word_bpe_49k.json")),
    "op10_quality": lambda s, d: quality.op10_quality(table(s, d, "documents"), table(s, d, "labels")),
    "op11_resampling": lambda s, d: dsir.op11_resample(table(s, d, "documents"), table(s, d, "benchmark")),
    "op12_nearest": lambda s, d: ann.op12_nearest(table(s, d, "embeddings")),
    "op13_fill_in_middle": lambda s, d: fim.op13_fill_in_middle(table(s, d, "documents")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(ALL)


def _license_sql() -> str:
    """Containment of every template's shingles in the whole text."""
    values = ", ".join(f"('{n}', [{', '.join(repr(w) for w in licenses.template_shingles(b))}])" for n, b in licenses.TEMPLATES.items())
    return f"""
        WITH t(template, wanted) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
        s AS (SELECT id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS s FROM d),
        m AS (SELECT id, template, len(list_intersect(wanted, s)) / len(wanted) AS best FROM s, t),
        g AS (SELECT id, string_agg(template, ',' ORDER BY template) AS licenses, count(*) AS n, max(best) AS best FROM m WHERE best >= 0.8 GROUP BY id)
        SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses, coalesce(best, 0.0) AS best FROM d LEFT JOIN g USING (id)
    """


#: SQL of the operators that SQL can express over whole tables.
SQL = {
    "op4_licenses": _license_sql(),
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
    """,
    "op7_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ), lengths AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
        ), found AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """.replace("\\", "\\"[:1]),
    "op13_fill_in_middle": """
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        g AS (SELECT row, doc_id, text, CAST(length(text) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, CAST(1 + 8 * i AS BIGINT), 8) AS BIGINT)) AS h FROM t),
        f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
              least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM g),
        p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
