"""Queries of the video catalogue, resuming, and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans import views as V
from framelake.sources import catalog, readers


def _metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("job-"), F.col("doc_id")).alias("job_id"), F.col("source").alias("name"), F.col("n_chars").alias("size"), F.col("doc_id").alias("created"))


def catalog_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known videos: jobs with a result and no checkpoint; the newest job of each name and size."""
    m = _metas(spark, sf_dir)
    return catalog.rebuild(m, m.filter("created % 3 > 0").select("job_id"), m.filter("created % 5 = 1").select("job_id"))


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _metas(spark, sf_dir).filter("created % 7 = 2").select("name", "size").distinct()
    return catalog.lookup(catalog_rebuild(spark, sf_dir), wanted)


def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows still to do: those past each video's last checkpoint."""
    t = V.timeline(spark, sf_dir)
    done = t.groupBy("video_id").agg((F.count("*") / 2).cast("bigint").alias("resume_from"))
    return catalog.remaining(t, done, "video_id").select("video_id", "pos")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a resumed run has, lacks or has otherwise."""
    a = V.timeline(spark, sf_dir).select("video_id", "pos", "level")
    b = a.filter("pos % 11 <> 4").select("video_id", "pos", F.when(F.col("pos") % 13 == 2, F.col("level") + 1).otherwise(F.col("level")).alias("level"))
    return catalog.compare(a, b, ["video_id", "pos"], "level")


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the events, among which two in fifty are planted as malformed."""
    record = F.expr("CASE event_id % 50 WHEN 7 THEN '{broken' WHEN 9 THEN 'nonsense' ELSE props END")
    e = V.table(spark, sf_dir, "events").select("event_id", record.alias("record"))
    return readers.parse_records(e, "record", "k BIGINT").select("event_id", F.col("record.k").alias("k"))


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir)
    return s.select("seg_id", F.to_json(F.struct("ss", "se", "conf", "approx")).alias("json"))


_METAS = "metas AS (SELECT 'job-' || doc_id AS job_id, source AS name, n_chars AS size, doc_id AS created FROM documents)"
_KNOWN = _METAS + ", known AS (SELECT name, size, arg_max(job_id, created) AS job_id, max(created) AS created FROM metas WHERE created % 3 > 0 AND created % 5 <> 1 GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (catalog_rebuild, catalog_lookup, resume_filter, compare_runs, json_scan, export_json)}
ORACLES = {
    "catalog_rebuild": f"WITH {_KNOWN} SELECT * FROM known",
    "catalog_lookup": f"WITH {_KNOWN} SELECT k.* FROM known k SEMI JOIN (SELECT * FROM metas WHERE created % 7 = 2) w ON w.name = k.name AND w.size = k.size",
    "resume_filter": f"WITH {V.TIMELINE}, d AS (SELECT video_id, count(*) // 2 AS n FROM timeline GROUP BY 1) SELECT video_id, pos FROM timeline JOIN d USING (video_id) WHERE pos >= n",
    "compare_runs": f"""WITH {V.TIMELINE} SELECT CASE WHEN pos % 11 = 4 THEN 'missing' WHEN pos % 13 = 2 THEN 'different' ELSE 'same' END AS state, count(*) AS n FROM timeline GROUP BY 1""",
    "json_scan": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 50 NOT IN (7, 9)",
    "export_json": f"""WITH {V.SEGMENTS} SELECT seg_id, '{{"ss":' || ss || ',"se":' || se || ',"conf":' || conf || ',"approx":' || approx || '}}' AS json FROM segments""",
}
