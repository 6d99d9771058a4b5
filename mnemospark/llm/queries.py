"""The operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.llm import byte_bpe, language_id, quality
from mnemospark.llm.centroids import cluster_vectors
from mnemospark.llm.common import fold, table
from mnemospark.llm.exact_dedup import exact_dedup
from mnemospark.llm.html_text import extract
from mnemospark.llm.maxent_lm import score_documents
from mnemospark.llm.near_dedup import near_dedup
from mnemospark.llm.packing import best_fit_packing
from mnemospark.llm.prefix_trie import conversation_trie
from mnemospark.llm.syncmers import edited_fingerprints
from mnemospark.llm.token_counts import token_counts
from mnemospark.llm.token_output import token_output


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark, sf_dir, accept=0.7):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= accept, 1).otherwise(0).alias("predicted"))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold(4) != 2, _vocabulary("piece_bpe_32k.model"))
    return language_id.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_html_suffix_array(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op7_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op8_syncmer_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_token_output(spark, sf_dir):
    return token_output(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_maxent_lm(spark, sf_dir):
    scored = score_documents(table(spark, sf_dir, "documents"), fold(10) != 0)
    return scored.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), limit=2048)


def op12_elkan_clusters(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5).drop("computed")


def op13_prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_language_id,
        op3_html_suffix_array,
        op4_exact_dedup,
        op5_byte_bpe,
        op6_minhash_near_dedup,
        op7_best_fit_packing,
        op8_syncmer_fingerprints,
        op9_token_output,
        op10_maxent_lm,
        op11_token_counts,
        op12_elkan_clusters,
        op13_prefix_trie,
    )
}


def _clusters_sql(k: int, rounds: int) -> str:
    """Plain rounds: every vector against every centroid in integers (squares and products as exact doubles), ties to the smaller number."""
    out = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, x, list_inner_product(x, x) AS xx FROM (
            SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT row_no, c, d FROM (SELECT row_no, c, xx + list_inner_product(t.x, t.x) - 2 * list_inner_product(v.x, t.x) AS d FROM v, c{r} t) QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY d, c) = 1)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT c, x, unnest(range(1, 65)) AS i FROM a{r} JOIN v USING (row_no)) GROUP BY c, i) GROUP BY c)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(s{r}.x, o.x) AS x FROM c{r} o LEFT JOIN s{r} USING (c))")
    return f"""WITH {', '.join(out)}
        SELECT v.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
               (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(t.x, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (row_no) JOIN c{rounds} t USING (c)"""


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

ORACLE_SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size,
               d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op12_elkan_clusters": _clusters_sql(40, 5),
    "op13_prefix_trie": f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS digest FROM t),
        o AS (SELECT conv_id, list({{'d': digest, 'b': strlen(text)}} ORDER BY turn NULLS FIRST, digest) AS turns FROM k GROUP BY conv_id),
        h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h, turns FROM o),
        r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(o.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS s FROM h LEFT JOIN o ON o.conv_id = h.base),
        p AS (SELECT conv_id, d, len(s) AS n, s[d].b AS bytes, sha256(array_to_string(list_transform(list_slice(s, 1, d), lambda x: x.d), '')) AS node FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
        g AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY d, node),
        l AS (SELECT DISTINCT a.d, a.node, b.d AS pd, b.node AS parent FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
        u AS (SELECT DISTINCT a.d, a.node, b.d AS ad, b.node AS anc FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d <= a.d),
        c AS (SELECT pd AS d, parent AS node, count(*) AS n FROM l GROUP BY ALL),
        w AS (SELECT ad AS d, anc AS node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((g.n_convs - 1) * coalesce(g.bytes, 0)) AS saved FROM u JOIN g USING (d, node) LEFT JOIN c USING (d, node) GROUP BY ALL)
        SELECT g.conv_id, g.d AS depth, pg.conv_id AS parent_conv_id, g.n_convs, coalesce(c.n, 0) AS n_children, w.n_leaves, w.saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
        FROM g JOIN w USING (d, node) LEFT JOIN c USING (d, node) LEFT JOIN l USING (d, node) LEFT JOIN g pg ON pg.d = l.pd AND pg.node = l.parent""",
}
