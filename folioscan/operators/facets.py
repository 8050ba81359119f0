"""Facets, lookups, validation and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.search import in_scope, payload


def list_tags(papers: DataFrame, domain: str | None = None, min_count: int = 1, prefix: str | None = None, head_limit: int | None = None) -> DataFrame:
    """(tag, n): how often each tag stands in the papers of a domain; repeats in one paper count. By count, then tag."""
    counts = in_scope(papers, domain).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    if prefix:
        counts = counts.where(F.lower("tag").startswith(prefix.lower()))
    ranked = counts.orderBy(F.desc("n"), "tag")
    return ranked if head_limit is None else ranked.limit(max(0, int(head_limit)))


def list_domains(papers: DataFrame) -> DataFrame:
    """(domain, n) over the domains that papers carry; empty names are left out."""
    names = papers.select(F.explode(F.split("domain", ",")).alias("domain")).where("domain <> ''")
    return names.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain")


def fulltext_status(papers: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(arxiv_id, enriched, indexed, source, n_chunks): what is known of each paper's full text.

    `sources` has (arxiv_id, source, n_chunks), where the count is the fetch's own, whether indexed or not.
    """
    known = sources.select("arxiv_id", F.lit(True).alias("enriched"), "source", "n_chunks")
    indexed = chunks.select("arxiv_id").distinct().withColumn("indexed", F.lit(True))
    return papers.select("arxiv_id").join(known, "arxiv_id", "left").join(indexed, "arxiv_id", "left").select(
        "arxiv_id", F.coalesce("enriched", F.lit(False)).alias("enriched"), F.coalesce("indexed", F.lit(False)).alias("indexed"), "source", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )


def paper_info(papers: DataFrame, id_: str, full_abstract: bool = False, sources: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One paper's payload with score 0, and its full-text status if that is asked of."""
    one = papers.where(F.col("arxiv_id") == id_)
    out = payload(one, F.lit(0.0), full_abstract)
    if sources is not None and chunks is not None:
        own = lambda d: d.where(F.col("arxiv_id") == id_)
        out = out.join(fulltext_status(one, own(sources), own(chunks)), "arxiv_id")
    return out


def list_enriched(sources: DataFrame) -> DataFrame:
    return sources.select("arxiv_id").distinct().orderBy("arxiv_id")


def validate_ids(requested: DataFrame, available: DataFrame, cached: DataFrame) -> DataFrame:
    """(arxiv_id, status) of each requested id: cached, ok (an HTML page is available) or pdf_fallback."""
    req = requested.select("arxiv_id").distinct()
    known = lambda d, name: d.select("arxiv_id").distinct().withColumn(name, F.lit(True))
    both = req.join(known(cached, "c"), "arxiv_id", "left").join(known(available, "a"), "arxiv_id", "left")
    return both.select("arxiv_id", F.when(F.col("c"), "cached").when(F.col("a"), "ok").otherwise("pdf_fallback").alias("status"))


def validation_summary(statuses: DataFrame) -> DataFrame:
    """Counts of a validation; cached ids are ok too."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return statuses.agg(F.count(F.lit(1)).alias("n_total"), is_("ok", "cached").alias("n_ok"), is_("pdf_fallback").alias("n_pdf_fallback"), is_("cached").alias("n_cached"))


def fetch_breakdown(results: DataFrame) -> DataFrame:
    """(source, n): where full texts came from; `unknown` without a source."""
    return results.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def fetch_summary(results: DataFrame) -> DataFrame:
    """n_total, n_ok, n_failed and the ids that failed, in order."""
    failed = F.when(F.col("error").isNotNull(), F.col("arxiv_id"))
    return results.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.array_sort(F.collect_list(failed)).alias("failed"))


def index_summary(chunks: DataFrame, model: str, dims: int, max_tokens: int) -> DataFrame:
    """n_papers, n_chunks and how the index was made."""
    return chunks.agg(F.countDistinct("arxiv_id").alias("n_papers"), F.count(F.lit(1)).alias("n_chunks")).select("*", F.lit(dims).alias("dims"), F.lit(model).alias("model"), F.lit(max_tokens).alias("max_seq_length"))


def overlap_at_k(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(query, overlap): shared ids among the k best of two rankings (query, id, rank), as a share of k."""
    top = lambda d: d.where(F.col("rank") <= k).select("query", "id").distinct()
    return top(left).join(top(right), ["query", "id"]).groupBy("query").agg(F.round(F.count(F.lit(1)) / k, 4).alias("overlap"))


def recall_at_k(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Recall at several depths and the median rank over (query, rank of the target or null)."""
    shares = [F.round(F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 4).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), *shares, F.percentile("rank", 0.5).alias("median_rank"))
