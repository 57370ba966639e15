"""Queries of the operators for training data, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm import dispersion, leakage, markov, neighbours, packing, repetition
from pointspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    m = markov.clusters(table(spark, d, "points"))
    return m.where("head_idx <> idx").select("head_idx", "idx")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return markov.described(table(spark, d, "points"))


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    return markov.described(table(spark, d, "points")).select("head_idx", "size")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each requested cloud were chosen."""
    return p4_select(spark, d).groupBy("cloud_id").agg(F.countDistinct("idx").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_select(spark, d).select("cloud_id", "head_idx").distinct()


def p4_select(spark: SparkSession, d: str) -> DataFrame:
    return dispersion.varied_subset(table(spark, d, "points"), table(spark, d, "subset_requests"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.most_similar(table(spark, d, "shot_feat"), 5, 0.38)
    return near.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_specs")
    return packing.fill_report(packing.pack(table(spark, d, "documents"), specs), specs)


def p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Which texts each capacity has in its containers: all of them."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_specs")).select("spec_id", "doc_id").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What the latent search finds before the exact check."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), check=False).select("doc_id", "item_id", "cosine")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    s = repetition.repeated_share(table(spark, d, "documents"))
    return s.where((F.col("n_words") >= 40) & (F.col("n_repeated") * 10 >= F.col("n_words") * 6)).select("doc_id")


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(table(spark, d, "documents"))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    return repetition.line_frequency(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_clusters": p1_clusters, "p1_sizes": p1_sizes, "p4_found": p4_found, "p4_select": p4_select, "p4_counts": p4_counts, "p5_found": p5_found, "p6_pack": p6_pack, "p6_fill": p6_fill, "p6_assigned": p6_assigned, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_candidates": p7_candidates, "p8_found": p8_found, "p8_share": p8_share, "p8_lines": p8_lines}


_REPEATED = """
    WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM l),
    g AS (SELECT doc_id, pos, lead(pos, 7) OVER o AS last, """ + " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(8)) + """ AS gram FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT doc_id, pos, CASE WHEN last IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 THEN 1 ELSE 0 END AS again FROM g),
    r AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS rep FROM f),
    s AS (SELECT doc_id, count(*) AS n_words, CAST(sum(rep) AS BIGINT) AS n_repeated FROM r GROUP BY doc_id)
"""

# all pairs of records of neighbouring cells, and the smallest idx handed on until none changes
_LINKED = """
        WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT idx, cloud_id, x, y, z, CASE WHEN label = -1 THEN NULL ELSE label END AS l, CAST(floor(x / 0.5) AS BIGINT) AS cx, CAST(floor(y / 0.5) AS BIGINT) AS cy, CAST(floor(z / 0.5) AS BIGINT) AS cz FROM points
            WHERE idx IS NOT NULL AND cloud_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND NOT (x = 0 AND y = 0 AND z = 0)),
        o AS (SELECT i, j, k FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k)),
        q AS (SELECT idx, cloud_id, x, y, z, l, cx + i AS cx, cy + j AS cy, cz + k AS cz FROM p, o),
        e AS MATERIALIZED (SELECT q.idx AS a, p.idx AS b FROM q JOIN p USING (cloud_id, cx, cy, cz) WHERE q.idx <> p.idx AND (q.l = p.l OR q.l IS NULL OR p.l IS NULL)
            AND (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) <= 0.25),
        cc(idx, head) USING KEY (idx) AS (SELECT idx, idx AS head FROM p UNION
            (SELECT e.b, min(w.head) FROM cc w JOIN e ON e.a = w.idx JOIN recurring.cc r ON r.idx = e.b WHERE w.head < r.head GROUP BY e.b))
"""

SQL = {
    "p1_found": _LINKED + "SELECT head AS head_idx, idx FROM (SELECT head, idx, count(*) OVER (PARTITION BY head) AS n FROM cc) WHERE n >= 10 AND head <> idx",
    "p1_sizes": _LINKED + "SELECT head AS head_idx, count(*) AS size FROM cc GROUP BY head HAVING count(*) >= 10",
    "p4_counts": """
        WITH w AS (SELECT cloud_id, max(n_wanted) AS wanted FROM subset_requests GROUP BY cloud_id),
        m AS (SELECT cloud_id, count(DISTINCT idx) AS there FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND NOT (x = 0 AND y = 0 AND z = 0) GROUP BY cloud_id)
        SELECT cloud_id, CAST(least(wanted, there) AS BIGINT) AS n FROM w JOIN m USING (cloud_id) WHERE wanted > 0
    """,
    # brute force over all pairs of vectors
    "p5_found": """
        WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, CAST(feat AS DOUBLE[]) AS f FROM shot_feat WHERE vec_id IS NOT NULL AND len(feat) = 352
                   AND len(list_filter(feat, lambda t: t IS NOT NULL AND NOT isnan(t) AND NOT isinf(t))) = 352 AND len(list_filter(feat, lambda t: t <> 0)) > 0),
        d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.f, b.f) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM d)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 5 AND dist <= 0.38
    """,
    "p6_assigned": "SELECT DISTINCT spec_id, doc_id FROM container_specs, documents WHERE doc_id IS NOT NULL AND spec_id IS NOT NULL",
    # lines counted over the documents of a host
    "p8_lines": """
        WITH d AS (SELECT doc_id, coalesce(repo, chr(1)) AS h, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+') AS s FROM documents WHERE doc_id IS NOT NULL),
        l AS (SELECT doc_id, h, unnest(s) AS line, unnest(range(len(s))) AS pos FROM d),
        n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS nl FROM l),
        o AS (SELECT h, nl FROM n WHERE nl <> '' GROUP BY h, nl HAVING count(DISTINCT doc_id) > 10),
        m AS (SELECT n.*, o.nl IS NOT NULL AS gone FROM n LEFT JOIN o ON o.h = n.h AND o.nl = n.nl),
        a AS (SELECT doc_id, count(*) FILTER (nl <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id),
        b AS (SELECT t.doc_id, t.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept FROM documents t LEFT JOIN a ON a.doc_id = t.doc_id),
        c AS (SELECT *, CASE WHEN n_lines > 0 THEN 1 - CAST(n_removed AS DOUBLE) / n_lines ELSE 1.0 END AS kept_share FROM b)
        SELECT doc_id, n_lines, n_removed, kept_share, kept_share < 0.5 AS depleted, CASE WHEN n_removed > 0 THEN kept ELSE text END AS kept_text FROM c
    """,
    # brute force over all pairs of records of the requested clouds
    "p4_found": """
        WITH p AS (SELECT DISTINCT idx, cloud_id, x, y, z FROM points JOIN (SELECT DISTINCT cloud_id FROM subset_requests) USING (cloud_id)
                   WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND NOT (x = 0 AND y = 0 AND z = 0)),
        h AS (SELECT a.cloud_id, a.idx, min(b.idx) AS head_idx FROM p a JOIN p b ON a.cloud_id = b.cloud_id
              AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 1.21 GROUP BY a.cloud_id, a.idx)
        SELECT DISTINCT cloud_id, head_idx FROM h
    """,
    # every window of 8 words of every text
    "p8_found": _REPEATED + "SELECT doc_id FROM s WHERE n_words >= 40 AND n_repeated * 10 >= n_words * 6",
    "p8_share": _REPEATED + """
        SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_repeated, 0) AS n_repeated,
               CASE WHEN s.n_words > 0 THEN CAST(s.n_repeated AS DOUBLE) / s.n_words ELSE 0.0 END AS share FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
