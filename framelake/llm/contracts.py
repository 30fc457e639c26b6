"""The thin queries over the driver's tables: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import conversations, decontamination, language, lines, lm, near_dup, packing, quality, ranking, rules, substrings, tokens, toxicity
from framelake.llm._stage import fold, table


def _held_out(modulus: int, remainder: int):
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=85)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).select("doc_id", _held_out(5, 0), "lang_pred", "score", "entropy", "rejected")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), modulus=7, remainder=2)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("text")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.remove_repeated_lines(table(spark, sf_dir, "documents"), size=3)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.apply_rules(docs, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)
    return scored.select("doc_id", _held_out(3, 1), "score", "predicted")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


ORACLES: dict[str, str] = {
    "op8_line_dedup": r"""
        WITH lined AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot
          FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), counted AS (
          SELECT doc_id, line, spot, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS no
          FROM lined WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
        ), windows AS (
          SELECT doc_id, no, [line, lead(line, 1) OVER w, lead(line, 2) OVER w] AS k, lead(line, 2) OVER w IS NOT NULL AS whole
          FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY no)
        ), ranked AS (
          SELECT doc_id, no, row_number() OVER (PARTITION BY k ORDER BY doc_id, no) AS r FROM windows WHERE whole
        ), gone AS (
          SELECT DISTINCT doc_id, no + d AS no FROM ranked, (VALUES (0), (1), (2)) AS t(d) WHERE r > 1
        ), marked AS (
          SELECT l.doc_id, l.line, l.spot, c.no IS NOT NULL AS counts, g.no IS NOT NULL AS removed
          FROM lined l LEFT JOIN counted c USING (doc_id, spot) LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.no = c.no
        ), kept AS (
          SELECT doc_id, count(*) FILTER (WHERE counts) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
                 coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE NOT removed), '') AS text
          FROM marked GROUP BY doc_id
        )
        SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(text) AS text_sha256 FROM kept
    """,
    "op12_ranked_search": r"""
        WITH cut AS (
          SELECT row_number() OVER () AS row_id, doc_id,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
          FROM documents WHERE text IS NOT NULL
        ), docs AS (
          SELECT row_id, doc_id, words, CAST(len(words) AS BIGINT) AS n FROM cut WHERE len(words) > 0
        ), totals AS (
          SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
        ), asked AS (
          SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE text IS NOT NULL)
          GROUP BY item_id, term
        ), postings AS (
          SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(words) AS term FROM docs)
          WHERE term IN (SELECT term FROM asked) GROUP BY row_id, doc_id, n, term
        ), weighed AS (
          SELECT term, CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * CAST(df AS DOUBLE) + 1))) AS BIGINT) AS w
          FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
        ), scored AS (
          SELECT a.item_id, p.row_id, p.doc_id,
                 sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * t.docs) // t.terms)))) AS score
          FROM asked a JOIN postings p USING (term) JOIN weighed w USING (term), totals t
          GROUP BY a.item_id, p.row_id, p.doc_id
        ), ranked AS (
          SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
    """,
}
