"""Queries of the core operators for drifting schemas (p2) and small files (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.operators import schema_drift, small_files
from pointspark.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "pcd_header")).select("file_id", "change_kind", "field_name")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "pcd_header")).drop("captured_at")


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.versions(table(spark, d, "pcd_header")).drop("fingerprint")


def p2_migrations(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.migrations(table(spark, d, "pcd_header"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.one_table(table(spark, d, "pcd_header"), table(spark, d, "pcd_body"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Read off the index of the archive after it was written."""
    index, _, begins = small_files.pack(table(spark, d, "txt_files"))
    return small_files.same_files(index, begins)


def p3_index(spark: SparkSession, d: str) -> DataFrame:
    return small_files.pack(table(spark, d, "txt_files"))[0]


def p3_restore(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the input, read back out of containers of 1 MiB."""
    index, blocks, _ = small_files.pack(table(spark, d, "txt_files"), 1 << 20)
    return small_files.restore(index, blocks).select("file_id", "save_path", F.decode("data", "UTF-8").alias("file_text"), "intact")


def p3_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each container with its number of bytes, the files stored whole and all files it restores, every file of the input read back and checked."""
    index, blocks, _ = small_files.pack(table(spark, d, "txt_files"), 1 << 20)
    back = small_files.restore(index, blocks).select("file_id", "intact")
    held = index.join(back, "file_id", "left").groupBy("container_id").agg(F.count_if(F.col("stored_as") == F.col("file_id")).alias("n_files"), F.min(F.coalesce("intact", F.lit(False))).alias("intact"), F.count("*").alias("n_restored"))
    return held.join(blocks.select("container_id", F.octet_length("block").alias("n_bytes")), "container_id")


def queries():
    return {"p2_found": p2_found, "p2_changes": p2_changes, "p2_versions": p2_versions, "p2_migrations": p2_migrations, "p2_table": p2_table, "p3_found": p3_found, "p3_index": p3_index, "p3_restore": p3_restore, "p3_containers": p3_containers}


_P2 = """
    WITH h AS (SELECT DISTINCT file_id, sensor_id, captured_at, fields, sizes, types, counts, lower(regexp_replace(data_type, '^\\s+|\\s+$', '', 'g')) AS st FROM pcd_header
               WHERE fields IS NOT NULL AND sizes IS NOT NULL AND types IS NOT NULL AND counts IS NOT NULL
               AND len(fields) = len(sizes) AND len(fields) = len(types) AND len(fields) = len(counts)),
    o AS (SELECT file_id, sensor_id, captured_at, st, lag(file_id) OVER w AS prev, lag(st) OVER w AS pst FROM (SELECT DISTINCT file_id, sensor_id, captured_at, st FROM h) WINDOW w AS (PARTITION BY sensor_id ORDER BY captured_at, file_id)),
    f AS (SELECT DISTINCT file_id, pos, lower(regexp_replace(fields[pos], '^\\s+|\\s+$', '', 'g')) AS name, sizes[pos] AS s, upper(trim(types[pos])) AS t, counts[pos] AS c
          FROM (SELECT *, unnest(range(1, len(fields) + 1)) AS pos FROM h)),
    nw AS (SELECT o.file_id, o.prev, f.pos, f.name, f.s, f.t, f.c FROM o JOIN f ON f.file_id = o.file_id WHERE o.prev IS NOT NULL),
    od AS (SELECT o.file_id, f.pos, f.name, f.s, f.t, f.c FROM o JOIN f ON f.file_id = o.prev),
    ad AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM od WHERE od.file_id = nw.file_id AND od.name = nw.name)),
    rm AS (SELECT * FROM od WHERE NOT EXISTS (SELECT 1 FROM nw WHERE od.file_id = nw.file_id AND od.name = nw.name)),
    rn AS (SELECT ad.file_id, ad.name, rm.name AS was FROM ad JOIN rm ON ad.file_id = rm.file_id AND ad.pos = rm.pos AND ad.s = rm.s AND ad.t = rm.t AND ad.c = rm.c),
    ch AS (SELECT file_id, 'renamed' AS change_kind, name AS field_name, was AS old_name, NULL AS detail FROM rn
    UNION SELECT file_id, 'added', name, NULL, NULL FROM ad WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.file_id = ad.file_id AND rn.name = ad.name)
    UNION SELECT file_id, 'removed', name, NULL, NULL FROM rm WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.file_id = rm.file_id AND rn.was = rm.name)
    UNION SELECT nw.file_id, 'retyped', nw.name, NULL, od.t || ' ' || od.s || ' ' || od.c || ' -> ' || nw.t || ' ' || nw.s || ' ' || nw.c FROM nw JOIN od ON od.file_id = nw.file_id AND od.name = nw.name WHERE nw.s <> od.s OR nw.t <> od.t OR nw.c <> od.c
    UNION SELECT file_id, 'storage', 'data', NULL, pst || ' -> ' || st FROM o WHERE prev IS NOT NULL AND st <> pst)
"""
_P2_VERSIONS = _P2 + """,
    ly AS (SELECT file_id, string_agg(name || '/' || t || '/' || s || '/' || c, ',' ORDER BY pos) AS ly FROM f GROUP BY file_id),
    lo AS (SELECT o.file_id, sensor_id, captured_at, ly || '/' || st AS ly FROM o JOIN ly ON ly.file_id = o.file_id),
    nx AS (SELECT *, CASE WHEN ly <> lag(ly) OVER (PARTITION BY sensor_id ORDER BY captured_at, file_id) THEN 1 ELSE 0 END AS fresh FROM lo)
    SELECT file_id, sensor_id, CAST(sum(fresh) OVER (PARTITION BY sensor_id ORDER BY captured_at, file_id) AS BIGINT) AS version FROM nx
"""


_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"

_P3 = f"""
    WITH c AS (SELECT DISTINCT file_id, file_text, replace(url_decode(replace(regexp_replace(trim(save_path), '^file:(//)?', ''), '+', '%2B')), chr(92), '/') AS p FROM txt_files),
    d0 AS (SELECT file_id, file_text, regexp_replace(regexp_replace(p, '/(\\./)+', '/', 'g'), '/+', '/', 'g') AS p FROM c),
    d1 AS (SELECT file_id, file_text, regexp_replace(regexp_replace(p, '/(\\./)+', '/', 'g'), '/[^/]+/\\.\\.(/|$)', '/') AS p FROM d0),
    n AS (SELECT file_id, p, unnest(string_split(replace(file_text, chr(13), chr(10)), chr(10))) AS line, unnest(range(1, len(string_split(replace(file_text, chr(13), chr(10)), chr(10))) + 1)) AS no FROM d1),
    v AS (SELECT file_id, p, no, regexp_extract_all(line, '{_NUMBER}') AS x FROM n),
    w AS (SELECT file_id, p, no, round(CAST(x[1] AS DOUBLE), 6) + 0.0 AS a, round(CAST(x[2] AS DOUBLE), 6) + 0.0 AS b, round(CAST(x[3] AS DOUBLE), 6) + 0.0 AS c FROM v WHERE len(x) > 0),
    k AS (SELECT file_id, p, row_number() OVER (PARTITION BY file_id ORDER BY no) AS k, a, b, c, count(*) OVER (PARTITION BY file_id) AS n FROM w),
    m AS (SELECT x.file_id AS file_a, y.file_id AS file_b, least(x.n, y.n) AS need, count(*) AS got FROM k x JOIN k y ON x.p = y.p AND x.file_id < y.file_id AND x.k = y.k
          AND x.a IS NOT DISTINCT FROM y.a AND x.b IS NOT DISTINCT FROM y.b AND x.c IS NOT DISTINCT FROM y.c GROUP BY 1, 2, 3)
    SELECT file_a, file_b FROM m WHERE need = got
"""


def oracle_sql():
    return {
        "p2_found": _P2 + "SELECT file_id, change_kind, field_name FROM ch",
        "p2_changes": _P2 + "SELECT ch.file_id, sensor_id, change_kind, field_name, old_name, detail FROM ch JOIN o ON o.file_id = ch.file_id",
        "p2_versions": _P2_VERSIONS,
        "p3_found": _P3,
        "p3_restore": "SELECT DISTINCT file_id, save_path, coalesce(file_text, '') AS file_text, true AS intact FROM txt_files WHERE file_id IS NOT NULL AND save_path IS NOT NULL",
    }
