"""The registered queries of this package and their SQL; each applies its operator to its whole table.

A query sets how many rows at a time go to Python workers (see small_batches); the operators leave the session's settings alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ctw_scoring, exact_dedup, hard_negatives, html_text, language_id, ngram_join, packing, periodic_runs, quality_rules, sentencepiece_scan, sstable, suffix_dedup, toxicity
from .common import held_out, small_batches
from .common import table as stored


def table(spark, sf_dir, name):
    small_batches(spark)
    return stored(spark, sf_dir, name)


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_scan.encode_decode(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality_rules(spark, sf_dir):
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_output(spark, sf_dir):
    return sstable.tokens_through_files(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_lm_scoring(spark, sf_dir):
    return ctw_scoring.score_documents(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), plant=True)


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel=True)


def queries():
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_token_output": op6_token_output,
        "op7_toxicity": op7_toxicity,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_html_extraction": op9_html_extraction,
        "op10_language_id": op10_language_id,
        "op11_lm_scoring": op11_lm_scoring,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_hard_negatives": op13_hard_negatives,
    }


ORACLE = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + o.o) AS n_repeat FROM k, (SELECT unnest([0, 1, 2]) AS o) o WHERE n >= 2 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
             + CASE WHEN n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) THEN 8 ELSE 0 END
             + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 7) = 0 AS kept, fail_bits, 'v1' AS policy FROM b
""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM w),
c AS (SELECT sh, len(sh) AS k, min(doc_id) AS copy_id, count(*) AS size FROM s GROUP BY sh),
x AS (SELECT copy_id, k, size, unnest(sh) AS g FROM c),
p AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS m, any_value(a.k) AS ka, any_value(b.k) AS kb, any_value(b.size) AS sb
      FROM x a JOIN x b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY 1, 2),
l AS (SELECT a, b, sb FROM p WHERE 5 * m >= 4 * (ka + kb - m)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links, sum(sb) AS n_docs FROM l GROUP BY a)
SELECT doc_id, CASE WHEN k = 0 THEN doc_id ELSE coalesce(g.class_id, copy_id) END AS class_id, CASE WHEN k = 0 THEN doc_id ELSE copy_id END AS copy_id,
       coalesce(n_links, 0) AS n_links, CASE WHEN k = 0 THEN 0 ELSE (coalesce(n_docs, 0) + size - 1)::BIGINT END AS n_linked_docs
FROM s JOIN c USING (sh) LEFT JOIN g ON g.a = copy_id LEFT JOIN n ON n.a = copy_id
""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
""",
}
