"""The registered queries of this subpackage, and DuckDB SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.annulus import op12_centroid_clusters
from rivulet.llm.bytebpe import op4_byte_bpe
from rivulet.llm.htmltext import op13_main_text
from rivulet.llm.licences import op10_license_scan
from rivulet.llm.packing import op6_best_fit_packing
from rivulet.llm.partenum import op8_ngram_jaccard_join
from rivulet.llm.pii import op2_pii
from rivulet.llm.quality import op9_quality
from rivulet.llm.runs import op11_periodic_runs
from rivulet.llm.spotsigs import op1_spotsigs
from rivulet.llm.tokenfiles import op3_orc_tokens
from rivulet.llm.topk import op5_exact_top_k
from rivulet.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_pii": op2_pii,
    "op3_orc_tokens": op3_orc_tokens,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_main_text": op13_main_text,
}


def _rounds(rounds: int) -> str:
    """CTEs of the rounds of op12 over v (n, vec_id, e): a0 assigns to c0, c1 has the means, and so on."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""
        a{i} AS MATERIALIZED (
            SELECT v.n, v.vec_id, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
            FROM v CROSS JOIN c{i} c
            QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY distance, c.cluster) = 1)""")
        if i < rounds:
            out.append(f"""
        s{i} AS (
            SELECT a.cluster, j, sum(v.e[j]) AS total, count(*) AS many
            FROM a{i} a JOIN v USING (n), unnest(range(1, 65)) AS r(j) GROUP BY a.cluster, j),
        m{i} AS (SELECT cluster, list(CAST((total - ((total % many) + many) % many) // many AS BIGINT) ORDER BY j) AS e FROM s{i} GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return ",".join(out)


ORACLE_SQL: dict[str, str] = {
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
    "op12_centroid_clusters": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS INTEGER) AS cluster, e FROM v
            QUALIFY cluster < 8),{_rounds(10)}
        SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a10 a JOIN c10 c USING (cluster)
    """,
}
