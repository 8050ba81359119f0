"""Parse quality of converted documents: headings, body lengths, and renders that only echo their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.text import normalize_heading, strip

NEAR_EMPTY_CHARS, NEAR_EMPTY_SHARE, SHORT_AVERAGE, LEAST_HEADINGS = 10, 0.70, 50, 3


def spans(markdown: Column, mark: str) -> Column:
    """Array of (heading, body) for each line that starts with `mark` (a regular expression)."""
    parts = F.split(F.concat(F.lit("\n"), markdown), rf"\n(?={mark})")
    titled = F.filter(parts, lambda p: p.rlike(rf"^{mark}"))
    return F.transform(titled, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("heading"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))


def _own_length(span: Column) -> Column:
    """Characters of a body beyond the repetition of its heading."""
    raw = strip(F.regexp_replace(span["heading"], "^#+", ""))
    body, heading, plain = span["body"], normalize_heading(raw), normalize_heading(span["body"])
    at = F.instr(F.lower(body), heading)
    rest = lambda start: F.length(strip(F.substring(body, start, F.length(body))))
    return (
        F.when(plain == heading, 0).when(F.lower(body).startswith(F.lower(raw)), rest(F.length(raw) + 1))
        .when((heading != "") & plain.startswith(heading) & (at > 0), rest(at + F.length(heading))).otherwise(F.length(body))
    )


def is_echo_skeleton(markdown: Column) -> Column:
    """Whether most sections hold nothing but their own heading; fewer than three headings say nothing."""
    lengths = F.transform(spans(markdown, "#"), _own_length)
    n = F.size(lengths)
    empty = F.size(F.filter(lengths, lambda x: x < NEAR_EMPTY_CHARS))
    total = F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    return F.when(n < LEAST_HEADINGS, False).otherwise((empty / n > NEAR_EMPTY_SHARE) | (total / n < SHORT_AVERAGE))


def parse_quality(docs: DataFrame, text_col: str = "markdown", branch_col: str = "source") -> DataFrame:
    """The rows with branch, n_headings, avg_body_len and echo_skeleton, the last for HTML only."""
    text = F.coalesce(text_col, F.lit(""))
    found = docs.withColumn("spans", spans(text, "## "))
    total = F.aggregate("spans", F.lit(0), lambda s, x: s + F.length(x["body"]))
    average = F.when(F.size("spans") == 0, F.length(text).cast("double")).otherwise(total / F.size("spans"))
    return found.select(
        *docs.columns, F.col(branch_col).alias("branch"), F.size("spans").alias("n_headings"), F.round(average, 1).alias("avg_body_len"),
        ((F.col(branch_col) == "html") & is_echo_skeleton(text)).alias("echo_skeleton"),
    )
