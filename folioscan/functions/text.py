"""String functions as column expressions: everything here stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title hits weigh this much against abstract hits.
TITLE_WEIGHT = 3
ABSTRACT_CHARS, AUTHORS = 600, 5
#: Retrieval prefixes that published encoders expect before a query or passage.
QUERY_PREFIXES = {
    "mxbai": "Represent this sentence for searching relevant passages: ",
    "bge": "Represent this sentence for searching relevant passages: ",
    "e5": "query: ",
    "qwen3": "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ",
}
PASSAGE_PREFIXES = {"e5": "passage: "}
#: Sections that are administrative, after their numbering.
JUNK_SECTION = (
    r"^(?:(?:s?[0-9]+(?:\.[0-9]+)*\.?|[ivxlcdm]+\.?|[a-z]\.)\s+)?(?:references?|acknowledge?ments?|bibliography|data availability|author contributions?"
    r"|funding|(?:competing|conflicts?) (?:of )?interests?|supplementary (?:material|information)|appendix [a-z])$"
)
#: Fixed value: the numbering that headings lose.
NUMBERING = r"^(?:appendix\s+[a-z]+\s+|[0-9]+\.?\s+|[ivxlcdm]+\.?\s+|[a-z]\.\s+)"


def strip(c: Column) -> Column:
    """Without white space at both ends; Unicode spaces count, as in Python."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def search_text(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), abstract)


def tokens(query: str | None) -> list[str]:
    return (query or "").lower().split()


def occurrences(haystack: Column, token: str) -> Column:
    """How often the token stands there, without overlaps."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(token), F.lit("")))) / F.lit(len(token))).cast("long")


def has_all(haystack: Column, words: list[str]) -> Column:
    """Whether every word is a substring, case aside; no words match nothing."""
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a & b, (F.lower(haystack).contains(w) for w in words))


def hit_score(words: list[str], weighted: list[tuple[Column, int]]) -> Column:
    parts = [occurrences(F.lower(c), w) * weight for w in words for c, weight in weighted]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0).cast("long")


def truncate(c: Column, n: int = ABSTRACT_CHARS) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def snippet(c: Column, words: list[str], n: int = 240) -> Column:
    """n characters from a little before the first hit, an ellipsis where the text is cut."""
    places = [F.nullif(F.instr(F.lower(c), w), F.lit(0)) for w in words]
    hit = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.lit(0), hit - 1 - n // 4)
    body = strip(F.substring(c, start + 1, F.lit(n)))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(F.length(c) > start + n, "…").otherwise(""))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalize_heading(c: Column) -> Column:
    """Lower case without up to two numbering prefixes."""
    once = F.regexp_replace(F.lower(strip(c)), NUMBERING, "")
    return strip(F.regexp_replace(once, NUMBERING, ""))


def is_junk_section(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).rlike(JUNK_SECTION)


def heading_level(css: Column) -> Column:
    """Markdown level of a title by its class; null for parts and for what is no title."""
    level = F.when(css.contains("ltx_title_document"), 1).when(css.contains("ltx_title_chapter"), 2).when(css.contains("ltx_title_part"), F.lit(None).cast("int"))
    for name, n in (("section", 2), ("subsection", 3), ("subsubsection", 4), ("paragraph", 5)):
        level = level.when(css.contains(f"ltx_title_{name}"), n)
    return level.when(css.contains("ltx_title"), 3)


def safe_image_name(src: Column) -> Column:
    """The file name of an image reference, in characters that cannot leave its folder."""
    path = F.regexp_replace(F.regexp_replace(src, r"[?#](?s:.*)$", ""), r"/+$", "")
    base = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1)
    name = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    return F.when(name == "", "figure.png").otherwise(name)


def rewrite_image_refs(markdown: Column, from_: str, to: str) -> Column:
    """Point image references of one folder to another."""
    if not from_ or from_ == to:
        return markdown
    import re

    return F.regexp_replace(markdown, rf"(!\[[^\]]*\]\(){re.escape(from_)}/", F.concat(F.lit("$1"), F.lit(to.replace("\\", "\\\\").replace("$", "\\$") + "/")))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def paper_url(id_: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), id_)


def encoder_family(model: str) -> str:
    name = model.lower()
    return next((k for k in ("mxbai", "bge", "qwen3", "e5") if k in name and (k != "e5" or "e5-" in name)), "")


def query_prefix(model: str) -> str:
    return QUERY_PREFIXES.get(encoder_family(model), "")


def passage_prefix(model: str) -> str:
    return PASSAGE_PREFIXES.get(encoder_family(model), "")
