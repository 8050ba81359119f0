import pytest
from pyspark.sql import functions as F

from folioscan import schema
from folioscan.operators import encode, facets, search

PAPERS = [
    ("2503.00001", "DFT study of mackinawite", "A", ["A", "B"], "Ab-initio surfaces of iron sulfide.", "c", [], "2025-03-01", "", "", [], ["dft", "ab-initio"], "chemistry"),
    ("2504.00001", "MLIP for organic crystals", "A", ["A"] * 7, "An MLIP model trained on QM9.", "c", [], "2025-04-01", "", "", [], ["mlip", "gnn"], "chemistry"),
    ("2504.00002", "Generative model for catalysts", "A", [], "Diffusion over catalysts " + "x" * 700, "c", [], "2025-04-02", "", "", [], ["generative-model", "catalysis"], "chemistry,physics"),
]


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(PAPERS, schema.PAPER)


def ids(df):
    return [r.arxiv_id for r in df.collect()]


def test_text_search(papers):
    assert ids(search.search_text(papers, "diffusion CATALYSTS")) == ["2504.00002"]
    assert search.search_text(papers, "MLIP").first().score > search.search_text(papers, "QM9").first().score
    assert ids(search.search_text(papers, "model", tag="generative-model")) == ["2504.00002"]
    assert ids(search.search_text(papers, "model", domain="physics")) == ["2504.00002"] and ids(search.search_text(papers, "model", domain="phys")) == []
    assert ids(search.search_text(papers, " ")) == []
    hit = search.search_text(papers, "diffusion").first()
    assert len(hit.abstract) == 601 and hit.url.endswith("/abs/2504.00002")
    assert len(search.search_text(papers, "mlip").first().authors) == 5


def test_semantic_search(spark, papers):
    e = encode.HashingEncoder()
    v = encode.encode_passages(papers.select("arxiv_id", F.concat_ws(" ", "title", "abstract").alias("text")), e).drop("text")
    assert ids(search.search_semantic(papers, v, encode.encode_query(e, "MLIP model for organic crystals trained on QM9"), 1)) == ["2504.00001"]
    near = ids(search.similar_to_abstract(papers, v, "2503.00001", 5))
    assert "2503.00001" not in near and len(near) == 2
    assert ids(search.similar_to_abstract(papers, v, "unknown")) == []
    assert ids(search.search_semantic(papers, v, encode.encode_query(e, "x"), 5, domain="physics")) == ["2504.00002"]


def chunk_rows(spark, names, scores):
    rows = [(f"p{i}", s, 0, i, [float(x), 0.0]) for i, (s, x) in enumerate(zip(names, scores, strict=True))]
    return spark.createDataFrame(rows, "arxiv_id string, section string, chunk_idx int, row int, embedding array<double>")


def test_junk_goes_last(spark):
    c = chunk_rows(spark, ["References", "Methods", "Results", "Introduction", "Discussion", "Header"], [1 - i * 0.01 for i in range(6)])
    out = search.search_chunks_semantic(c.drop("embedding").withColumn("text", F.lit("t")), c, [1.0, 0.0], 3).collect()
    assert [r.section for r in out] == ["Methods", "Results", "Introduction"]
    c = chunk_rows(spark, ["References", "Acknowledgments", "Methods"], [1, 0.99, 0.98])
    assert [r.section for r in search.search_chunks_semantic(c.drop("embedding").withColumn("text", F.lit("t")), c, [1.0, 0.0], 5).collect()] == ["Methods", "References", "Acknowledgments"]


def test_chunk_text_ties_keep_row_order(spark):
    texts = ["alpha beta gamma — references list with alpha beta", "alpha beta — methods section using alpha beta", "alpha beta — results contain alpha beta findings"]
    rows = [(f"p{i}", s, 0, i, t) for i, (s, t) in enumerate(zip(["References", "Methods", "Results"], texts, strict=True))]
    c = spark.createDataFrame(rows, "arxiv_id string, section string, chunk_idx int, row int, text string")
    assert [r.section for r in search.search_chunks_text(c, "alpha beta", 2).collect()] == ["Methods", "Results"]
    assert search.search_chunks_text(c, "", 2).count() == 0


def test_similar_to_paper(spark):
    rows = [("a", "X", 0, 0, [1.0, 0.0]), ("a", "Y", 1, 1, [0.0, 1.0]), ("b", "Far", 0, 2, [-1.0, 0.0]), ("b", "Near", 1, 3, [0.7, 0.7]), ("c", "Only", 0, 4, [0.0, 1.0])]
    c = spark.createDataFrame(rows, "arxiv_id string, section string, chunk_idx int, row int, embedding array<double>")
    assert [(r.arxiv_id, r.section) for r in search.similar_to_paper(c, "a").collect()] == [("b", "Near"), ("c", "Only")]
    assert search.similar_to_paper(c, "zz").count() == 0


def test_facets(papers):
    assert {(r.domain, r.n) for r in facets.list_domains(papers).collect()} == {("chemistry", 3), ("physics", 1)}
    assert facets.list_tags(papers, min_count=2).count() == 0
    assert [r.tag for r in facets.list_tags(papers, prefix="D").collect()] == ["dft"]
    assert facets.list_tags(papers, head_limit=2).count() == 2


def test_rerank(papers):
    out = search.rerank(papers, "q", lambda q, texts: [("MLIP" in t) * 2 - len(t) / 1e6 for t in texts], 2)
    assert out.first().arxiv_id == "2504.00001" and out.count() == 2
    assert search.rerank(papers.where("false"), "q", lambda q, t: 1 / 0, 2).count() == 0
