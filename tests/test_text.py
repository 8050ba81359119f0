import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("title,want", [
    ("Bibliography", True), ("12. Reference", True), ("xi. FUNDING", True), ("B. Author contribution", True), ("S2.1 References", True), ("  appendix q ", True), ("Conflicts of interest", True), ("competing interest", True),
    ("3 Acknowledgment", True), ("data availability", True), ("Supplementary material", True), (None, False), ("", False), ("Reference data sets", False), ("Funding models", False), ("Appendix", False),
    ("Appendix AB", False), ("References and notes", False), ("2 Related work", False), ("A reference frame", False), ("Outlook", False),
])
def test_junk_sections(spark, title, want):
    assert one(spark, T.is_junk_section(F.lit(title).cast("string"))) is want


@pytest.mark.parametrize("raw,want", [("7.  Model", "model"), ("7 Model", "model"), ("xii Outlook", "outlook"), ("III. Outlook", "outlook"), ("B. Data", "data"), ("Appendix C Proofs", "proofs"),
                                      ("Appendix C 2. Proofs", "proofs"), ("RESULTS ", "results"), ("", ""), ("3.1 Grid", "3.1 grid"), ("lattice energy", "lattice energy")])
def test_headings(spark, raw, want):
    assert one(spark, T.normalize_heading(F.lit(raw))) == want


@pytest.mark.parametrize("src,want", [("a/b/plot-1.svg", "plot-1.svg"), ("c/d e+f.png?x=1#y", "d_e_f.png"), ("../..", "figure.png"), ("/", "figure.png"), ("..\\up\\.hidden.gif", "hidden.gif"), ("a/b/", "b")])
def test_image_names(spark, src, want):
    from folioscan.operators.extract import image_name

    assert one(spark, T.safe_image_name(F.lit(src))) == want == image_name(src)


def test_truncate_and_snippet(spark):
    assert len(one(spark, T.truncate(F.lit("a" * 700)))) == 601 and one(spark, T.truncate(F.lit("a" * 600))) == "a" * 600
    assert one(spark, T.snippet(F.lit("x" * 500 + " needle " + "y" * 500), ["needle"], 100)).count("needle") == 1
    assert one(spark, T.snippet(F.lit("short"), ["nothing"], 100)) == "short"
    assert len(one(spark, T.snippet(F.lit("word " * 400), [], 600))) >= 590


def test_image_refs(spark):
    md = "![](images/a.png)\n![a picture](images/b.svg)\n![](elsewhere/c.png)"
    got = one(spark, T.rewrite_image_refs(F.lit(md), "images", "x$1.media"))
    assert got == "![](x$1.media/a.png)\n![a picture](x$1.media/b.svg)\n![](elsewhere/c.png)"
    assert one(spark, T.rewrite_image_refs(F.lit(md), "images", "images")) == md


def test_whitespace_counts_and_prefixes(spark):
    assert one(spark, T.normalize_whitespace(F.lit(" a  \n\n\n\nb "))) == "a\n\nb"
    assert one(spark, T.clean_text(F.lit("\ta \n b "))) == "a b"
    assert one(spark, T.occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(spark, T.estimate_tokens(F.lit(""))) == 1 and one(spark, T.estimate_tokens(F.lit("a" * 400))) == 100
    assert T.query_prefix("mixedbread-ai/mxbai-embed-large-v1").startswith("Represent this sentence") and T.passage_prefix("mixedbread-ai/mxbai-embed-large-v1") == ""
    assert T.query_prefix("intfloat/e5-base-v2") == "query: " and T.passage_prefix("intfloat/e5-base-v2") == "passage: " and T.query_prefix("other") == ""


@pytest.mark.parametrize("css,level", [("ltx_title ltx_title_document", 1), ("ltx_title_chapter", 2), ("ltx_title_part", None), ("ltx_title_section", 2), ("ltx_title_subsection", 3), ("ltx_title_subsubsection", 4), ("ltx_title_paragraph", 5), ("ltx_title", 3), ("x", None)])
def test_heading_levels(spark, css, level):
    from folioscan.operators.extract import title_level

    assert one(spark, T.heading_level(F.lit(css))) == level == title_level(css)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(12.0))
    assert one(spark, V.normalize(v)) == pytest.approx([3 / 13, 4 / 13, 12 / 13])
    assert one(spark, V.shorten(v, 2)) == pytest.approx([0.6, 0.8])
    assert one(spark, V.shorten(v, 9)) == [3, 4, 12] and one(spark, V.shorten(v, None)) == [3, 4, 12]
    assert one(spark, V.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
