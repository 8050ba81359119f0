"""Keyword and vector search over papers and chunks: filter, score, top k, and only then the wide columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import vectors as V

#: Chunk searches look at this many times k candidates before administrative sections go last.
OVERSAMPLE = 4
RRF_K = 60


def in_scope(papers: DataFrame, domain: str | None = None, tag: str | None = None) -> DataFrame:
    """Papers of a domain and with a tag, both by exact membership; an empty argument filters nothing."""
    if domain:
        papers = papers.where(F.array_contains(F.split("domain", ","), domain))
    if tag:
        papers = papers.where(F.array_contains("tags", tag))
    return papers


def payload(papers: DataFrame, score: Column, full_abstract: bool = False) -> DataFrame:
    """The columns that a hit shows."""
    return papers.select(
        "arxiv_id", "title", "first_author", F.slice("authors", 1, T.AUTHORS).alias("authors"),
        (F.col("abstract") if full_abstract else T.truncate(F.col("abstract"))).alias("abstract"), "published", "updated", "tags", "topics", "domain",
        T.paper_url(F.col("arxiv_id")).alias("url"), F.round(score, 4).alias("score"),
    )


def search_text(papers: DataFrame, query: str, k: int = 10, domain: str | None = None, tag: str | None = None) -> DataFrame:
    """Papers whose title and abstract hold every token; title hits count three times. Ties go by id."""
    words = T.tokens(query)
    both = T.search_text(F.col("title"), F.col("abstract"))
    score = T.hit_score(words, [(F.col("title"), T.TITLE_WEIGHT), (F.col("abstract"), 1)])
    hits = in_scope(papers, domain, tag).where(T.has_all(both, words)).withColumn("score", score.cast("double"))
    return payload(hits.orderBy(F.desc("score"), "arxiv_id").limit(k), F.col("score"))


def top_vectors(vectors: DataFrame, query: list[float] | Column, k: int, id_col: str = "arxiv_id", exclude: str | None = None) -> DataFrame:
    """(id, score): the k vectors with the largest dot product with the query; ties go by id. Reads ids and vectors only."""
    q = query if isinstance(query, Column) else V.literal(query)
    if exclude is not None:
        vectors = vectors.where(F.col(id_col) != exclude)
    return vectors.select(id_col, V.dot(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def search_semantic(papers: DataFrame, vectors: DataFrame, query: list[float], k: int = 10, domain: str | None = None, tag: str | None = None) -> DataFrame:
    """The papers nearest to a vector. A scope restricts the vectors before ranking; the k hits then fetch their columns."""
    if domain or tag:
        vectors = vectors.join(in_scope(papers, domain, tag).select("arxiv_id"), "arxiv_id", "left_semi")
    best = top_vectors(vectors, query, k)  # at most k rows, so broadcasting them is bounded
    return payload(papers.join(F.broadcast(best), "arxiv_id"), F.col("score")).orderBy(F.desc("score"), "arxiv_id")


def vector_of(vectors: DataFrame, id_: str) -> list[float] | None:
    row = vectors.where(F.col("arxiv_id") == id_).select("embedding").first()
    return None if row is None else [float(x) for x in row[0]]


def similar_to_abstract(papers: DataFrame, vectors: DataFrame, id_: str, k: int = 10) -> DataFrame:
    """Neighbours of a paper's abstract, itself excluded; an unknown id has none."""
    q = vector_of(vectors, id_)
    if q is None:
        return payload(papers.where(F.lit(False)), F.lit(0.0))
    best = top_vectors(vectors, q, k, exclude=id_)
    return payload(papers.join(F.broadcast(best), "arxiv_id"), F.col("score")).orderBy(F.desc("score"), "arxiv_id")


def demote_junk(scored: DataFrame, k: int, order: str = "row", section: str = "section") -> DataFrame:
    """Of the 4k best the clean sections first and administrative ones after, each by score; equal scores keep row order."""
    pool = scored.orderBy(F.desc("score"), order).limit(OVERSAMPLE * k)
    return pool.withColumn("junk", T.is_junk_section(F.col(section))).orderBy("junk", F.desc("score"), order).limit(k)


def search_chunks_text(chunks: DataFrame, query: str, k: int = 10, snippet_chars: int = 240) -> DataFrame:
    """Chunks (arxiv_id, section, chunk_idx, text, row) that hold every token, by number of hits."""
    words = T.tokens(query)
    hits = chunks.where(T.has_all(F.col("text"), words)).withColumn("score", T.hit_score(words, [(F.col("text"), 1)]).cast("double"))
    best = demote_junk(hits, k)
    return best.select("arxiv_id", "section", "chunk_idx", T.snippet(F.col("text"), words, snippet_chars).alias("snippet"), F.round("score", 4).alias("score"), "row")


def search_chunks_semantic(chunks: DataFrame, vectors: DataFrame, query: list[float], k: int = 10, snippet_chars: int = 240) -> DataFrame:
    """Chunks nearest to a vector; `vectors` has (row, section, embedding). The text is joined to the k hits only; without one a snippet is empty."""
    scored = vectors.select("row", "section", V.dot(F.col("embedding"), V.literal(query)).alias("score"))
    best = demote_junk(scored, k).select("row", "score")
    found = F.broadcast(best).join(chunks.drop("score"), "row", "left")
    text = F.coalesce("text", F.lit(""))
    return found.select("arxiv_id", "section", "chunk_idx", T.snippet(text, [], snippet_chars).alias("snippet"), F.round("score", 4).alias("score"), "row").orderBy(T.is_junk_section(F.col("section")), F.desc("score"), "row")


def mean_vectors(vectors: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """(id, embedding): the component-wise mean of each id's vectors, one partial aggregate for each component of the first vector."""
    row = vectors.select(F.size("embedding").alias("n")).where("n > 0").first()
    if row is None:
        return vectors.select(id_col, F.array().cast("array<double>").alias("embedding")).where(F.lit(False))
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(row.n)]
    return vectors.groupBy(id_col).agg(*means).select(id_col, F.array(*(F.col(f"m{i}") for i in range(row.n))).alias("embedding"))


def first_rows(chunks: DataFrame, id_col: str = "arxiv_id", order: str = "row") -> DataFrame:
    """(id, row): where each paper's first chunk stands."""
    return chunks.groupBy(id_col).agg(F.min(order).alias(order))


def similar_to_paper(chunks: DataFrame, id_: str, k: int = 10) -> DataFrame:
    """(arxiv_id, section, score): for each other paper its chunk nearest to the mean of this paper's chunks. `chunks` has (arxiv_id, section, chunk_idx, embedding)."""
    own = mean_vectors(chunks.where(F.col("arxiv_id") == id_)).select(V.normalize(F.col("embedding")).alias("q")).first()
    if own is None:
        return chunks.where(F.lit(False)).select("arxiv_id", "section", F.lit(0.0).alias("score"))
    scored = chunks.where(F.col("arxiv_id") != id_).select("arxiv_id", "section", "chunk_idx", V.dot(F.col("embedding"), V.literal(own.q)).alias("score"))
    best = scored.groupBy("arxiv_id").agg(F.max_by("section", F.struct("score", -F.col("chunk_idx"))).alias("section"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "arxiv_id").limit(k).select("arxiv_id", "section", F.round("score", 4).alias("score"))


#: Candidates that a scorer gets at most.
RERANK = 50


def rerank(hits: DataFrame, query: str, scorer, k: int = 10, most: int = RERANK) -> DataFrame:
    """Of the `most` best hits (arxiv_id, title, abstract, ..; by their score, if they have one) the k that a scorer likes best. scorer: (query, list of texts) -> list of numbers; it is not called without rows."""
    best = [F.desc("score")] if "score" in hits.columns else []
    hits = hits.orderBy(*best, "arxiv_id").limit(most)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(list(map(float, scorer(query, text.tolist()))) if len(text) else [], dtype="float64")

    return hits.withColumn("score", score(T.search_text(F.col("title"), F.col("abstract")))).orderBy(F.desc("score"), "arxiv_id").limit(k)


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) by reciprocal rank over (list, id, rank) rows."""
    return lists.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"))
