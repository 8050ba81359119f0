"""Markdown to sections to overlapping chunks, as array expressions on one row per document: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import estimate_tokens, strip

MAX_TOKENS, OVERLAP = 4096, 0.12
#: Upper bounds in tokens and batch sizes of the encoder's buckets.
BUCKETS = ((512, 64), (2048, 16), (4096, 8))


def sections(markdown: Column) -> Column:
    """Array of (section, body): the text before the first `## ` heading is Header, text without headings Body; empty ones are left out."""
    parts = F.split(F.concat(F.lit("\n"), markdown), r"\n## ")
    head = F.struct(F.when(F.size(parts) > 1, "Header").otherwise("Body").alias("section"), strip(parts[0]).alias("body"))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("section"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))
    return F.filter(F.concat(F.array(head), rest), lambda s: s["body"] != "")


def pack(body: Column, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> Column:
    """Array of chunk texts: paragraphs packed greedily; a new chunk starts with the last paragraphs of the one before, at least one, until they reach the overlap.

    A paragraph longer than a chunk passes through whole.
    """
    paragraphs = F.filter(F.split(body, r"\n\n"), lambda p: strip(p) != "")
    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), estimate_tokens(p).alias("n")))
    item = "array<struct<p:string,n:int>>"
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])
    budget = F.lit(float(overlap * max_tokens))

    def tail(cur: Column) -> Column:
        if overlap <= 0:
            return F.array().cast(item)
        take = lambda s, x: F.when(total(s) < budget, F.concat(F.array(x), s)).otherwise(s)
        return F.aggregate(F.reverse(cur), F.array().cast(item), take)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(item).alias("cur"))
    text = lambda cur: F.array_join(F.transform(cur, lambda x: x["p"]), "\n\n")

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (total(s["cur"]) + x["n"] > max_tokens)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(text(s["cur"])))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, tail(s["cur"])).otherwise(s["cur"]), F.array(x)).alias("cur"),
        )

    return F.aggregate(sized, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(text(s["cur"])))).otherwise(s["done"]))


def chunk_markdown(docs: DataFrame, id_col: str = "arxiv_id", text_col: str = "markdown", max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """(arxiv_id, section, chunk_idx, text, n_chars, n_tokens_est); chunk_idx starts anew in each section."""
    by_section = docs.select(F.col(id_col).alias("arxiv_id"), F.explode(sections(F.coalesce(text_col, F.lit("")))).alias("s"))
    chunks = by_section.select("arxiv_id", F.col("s.section").alias("section"), F.posexplode(pack(F.col("s.body"), max_tokens, overlap)).alias("chunk_idx", "text"))
    return chunks.select("arxiv_id", "section", "chunk_idx", "text", F.length("text").alias("n_chars"), estimate_tokens(F.col("text")).alias("n_tokens_est"))


def with_texts(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk records with their text derived again; the empty text where there is none."""
    keys = ["arxiv_id", "section", "chunk_idx"]
    return meta.join(chunks.select(*keys, "text"), keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def bucket(n_tokens: Column) -> Column:
    out = None
    for most, _ in BUCKETS:
        name = F.lit(f"≤{most}t")
        out = F.when(n_tokens <= most, name) if out is None else out.when(n_tokens <= most, name)
    return out.otherwise(F.lit(f">{BUCKETS[-1][0]}t"))


def bucket_counts(chunks: DataFrame) -> DataFrame:
    """(bucket, n, n_tokens) of chunks by estimated length."""
    return chunks.groupBy(bucket(F.col("n_tokens_est")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens_est").alias("n_tokens"))
