"""The engine's relations from the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: first line the title, the rest the abstract, language and source the domains, labels the tags."""
    d = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    title = F.substring_index("text", "\n", 1)
    tags = F.when(F.col("quality").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("quality-"), F.col("quality").cast("string")), F.concat(F.lit("toxic-"), F.col("toxic").cast("string"))))
    none = F.array().cast("array<string>")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("arxiv_id"), title.alias("title"), F.col("source").alias("first_author"), F.array("source", "lang").alias("authors"),
        F.expr("substr(text, length(substring_index(text, chr(10), 1)) + 2)").alias("abstract"), F.col("lang").alias("primary_category"), none.alias("categories"),
        F.lit("2025-01-01").alias("published"), F.lit("2025-01-02").alias("updated"), F.lit("").alias("pdf_url"), none.alias("topics"), tags.alias("tags"),
        F.concat_ws(",", "lang", "source").alias("domain"),
    )


PAPERS = """
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
papers AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS arxiv_id, split_part(text, chr(10), 1) AS title, source AS first_author, source || '|' || lang AS authors,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, lang, source,
         CASE WHEN quality IS NULL THEN [] ELSE ['quality-' || quality, 'toxic-' || toxic] END AS tags, lang || ',' || source AS domain
  FROM documents d LEFT JOIN lab USING (doc_id))
"""
#: The payload's columns over `papers` and a score.
PAYLOAD = """arxiv_id, title, first_author, authors, CASE WHEN length(abstract) > 600 THEN substr(abstract, 1, 600) || '…' ELSE abstract END AS abstract,
  '2025-01-01' AS published, '2025-01-02' AS updated, array_to_string(tags, '|') AS tags, '' AS topics, domain, 'https://arxiv.org/abs/' || arxiv_id AS url"""


def paper_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as abstract vectors: a vector belongs to the document of its number."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("arxiv_id"), "embedding")


#: Section names by vec_id modulo 8.
SECTIONS = ("Abstract", "1 Introduction", "Methods", "References", "Results", "V Acknowledgements", "Discussion", "Appendix A")


def section_of(n: Column) -> Column:
    out = None
    for i, name in enumerate(SECTIONS):
        out = F.when(n % 8 == i, name) if out is None else out.when(n % 8 == i, name)
    return out


SECTION_SQL = "CASE vec_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SECTIONS)) + " END"


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunk vectors: five to a paper, with a section each."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 5).cast("string").alias("arxiv_id"), section_of(F.col("vec_id")).alias("section"), (F.col("vec_id") % 5).cast("int").alias("chunk_idx"), F.col("vec_id").alias("row"), "embedding")


CHUNK_VECTORS = f"cv AS (SELECT CAST(vec_id // 5 AS VARCHAR) AS arxiv_id, {SECTION_SQL} AS section, CAST(vec_id % 5 AS INTEGER) AS chunk_idx, vec_id AS row, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as markdown: a `## role turn` section for each turn, lines as paragraphs."""
    c = load(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    return c.groupBy(F.col("conv_id").cast("string").alias("arxiv_id")).agg(F.concat(F.lit("# Conversation\n\n"), F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n")).alias("markdown"))


MARKDOWN = """
md AS (SELECT CAST(conv_id AS VARCHAR) AS arxiv_id, '# Conversation' || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10)
  || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a job log: a user is a job, the event type its state."""
    e = load(spark, sf_dir, "events")
    state = F.element_at(F.array(*(F.lit(s) for s in ("pending", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), state.alias("state"), F.col("ts").cast("timestamp_ntz").alias("at"))


JOBS = "je AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS kind, (['pending','running','done','failed'])[event_id % 4 + 1] AS state, ts AS moment FROM events)"
