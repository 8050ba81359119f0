import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscan.operators import chunking, extract, quality


def first(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def split(spark, md):
    return [(s.section, s.body) for s in first(spark, md, chunking.sections)]


def test_sections(spark):
    assert split(spark, "# T\n\nabs\n\n## A\n\na1\n\n### sub\n\na2\n\n## B\n\nb") == [("Header", "# T\n\nabs"), ("A", "a1\n\n### sub\n\na2"), ("B", "b")]
    assert split(spark, "just text") == [("Body", "just text")]
    assert split(spark, "## A\n\n## B\n\nb") == [("B", "b")]
    assert split(spark, "") == []
    assert split(spark, "## M\n\n$a_1 \\sum$") == [("M", "$a_1 \\sum$")]


def packed(spark, text, most, overlap):
    return first(spark, text, lambda c: chunking.pack(c, most, overlap))


def test_packing(spark):
    paragraphs = [c * 400 for c in "abcde"]
    out = packed(spark, "\n\n".join(paragraphs), 200, 0.2)
    assert out == ["\n\n".join(paragraphs[i : i + 2]) for i in range(4)]  # a paragraph of 100 tokens is carried though the budget is 40
    assert packed(spark, "\n\n".join(paragraphs), 200, 0.0) == ["\n\n".join(paragraphs[0:2]), "\n\n".join(paragraphs[2:4]), paragraphs[4]]
    assert packed(spark, "x" * 4000, 100, 0.1) == ["x" * 4000]
    small = [f"p{i} " + "w" * 80 for i in range(20)]
    out = packed(spark, "\n\n".join(small), 100, 0.12)
    assert 1 < len(out) <= 20 and all(any(p in c for c in out) for p in small)
    assert packed(spark, "", 100, 0.1) == []


def test_chunks(spark):
    docs = spark.createDataFrame([("a", "## S\n\n" + "\n\n".join("y" * 100 for _ in range(8)) + "\n\n## R\n\nz"), ("n", None)], "arxiv_id string, markdown string")
    rows = chunking.chunk_markdown(docs, max_tokens=60, overlap=0.1).collect()
    assert [r.chunk_idx for r in rows if r.section == "S"] == list(range(len(rows) - 1)) and [r.chunk_idx for r in rows if r.section == "R"] == [0]
    assert {r.bucket for r in chunking.bucket_counts(chunking.chunk_markdown(docs)).collect()} == {"≤512t"}


PROSE = "This section has a real body with well over fifty characters of running text in it. "


@pytest.mark.parametrize("md,want", [
    ("# T\n\n## Abstract\n\nAbstract\n\n## 1 Introduction\n\nIntroduction\n\n## 2 Methods\n\nMethods", True),
    ("# T\n\n## A\n\n" + PROSE * 3 + "\n\n## B\n\n" + PROSE * 3 + "\n\n## C\n\n" + PROSE * 3, False),
    ("## A\n\nA\n\n## B\n\nB", False), ("", False), ("# T\n\n## I Intro\n\nintro and a bit\n\n## II Next\n\n" + PROSE, True),
])
def test_echo_skeleton(spark, md, want):
    assert first(spark, md, quality.is_echo_skeleton) is want


def test_parse_quality(spark):
    docs = spark.createDataFrame([("html", "# T\n\n## A\n\nabcd\n\n## B\n\nabcdef"), ("latex", "no headings"), ("html", None)], "source string, markdown string")
    got = [(r.branch, r.n_headings, r.avg_body_len, r.echo_skeleton) for r in quality.parse_quality(docs).collect()]
    assert got == [("html", 2, 5.0, True), ("latex", 0, 11.0, False), ("html", 0, 0.0, False)]


PAGE = """<html><head><title>x</title></head><body><nav>menu</nav><article class="ltx_document"><h1 class="ltx_title ltx_title_document">Deep  Title</h1>
<div class="ltx_abstract"><h6 class="ltx_title ltx_title_abstract">Abstract</h6><p>We do <math display="inline"><annotation encoding="application/x-tex">x^2</annotation></math>.</p></div>
<section><h2 class="ltx_title ltx_title_section">1 Intro</h2><p>Text <a href="https://e.org/p">link</a> and <a href="#s">here</a>.</p><img src="2603v1/f1.png" alt="Refer"><p>More<script>bad()</script></p></section>
<h2 class="ltx_title ltx_title_part">Main</h2><div class="ltx_pagination">pages</div></article></body></html>"""


def test_html(spark):
    md, images = extract.html_page(PAGE, "https://a.org/html/2603v1", "2603.media")
    assert md.startswith("# Deep Title\n\n## Abstract\n\nWe do $x^2$.\n\n## 1 Intro\n\nText [link](https://e.org/p) and here.")
    assert "![](2603.media/f1.png)" in md and images == [{"name": "f1.png", "url": "https://a.org/html/2603v1/f1.png"}]
    assert not any(x in md for x in ("menu", "bad()", "pages", "Main"))
    assert extract.html_page("<p><b>open<br><p>next")[0] == "open\n\nnext" and extract.html_page("")[0] == ""
    rows = spark.createDataFrame([(PAGE,), (None,)], "h string").select(extract.html_to_markdown(F.col("h"))["markdown"].alias("m")).collect()
    assert rows[0].m.startswith("# Deep Title") and rows[1].m == ""


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


MAIN = "\\documentclass{article}\n\\begin{document}\n\\section{First Part}\nBody $a+b$ 10\\% % note\n\\input{sec/two}\n\\end{document}"


def test_eprint(spark):
    full = extract.unpack_eprint(tar({"main.tex": MAIN, "sec/two.tex": "\\subsection*{Second}\nTwo \\emph{words}", "x.bib": "@"}))
    assert "Second" in full and extract.unpack_eprint(gzip.compress(MAIN.encode())) == MAIN and extract.unpack_eprint(MAIN.encode()) == MAIN
    assert extract.unpack_eprint(b"junk") is None and extract.unpack_eprint(tar({"a.txt": "x"})) is None
    assert extract.tex_to_markdown(full) == "## First Part\n\nBody $a+b$ 10%\n\n## Second\n\nTwo words"
    assert extract.tex_to_markdown("no sections") is None
    loop = {"a.tex": "\\input{a}"}
    damaged = tar({"m.tex": MAIN * 50})
    damaged = damaged[:40] + bytes(60) + damaged[100:]
    assert extract.unpack_eprint(damaged) is None and extract.unpack_eprint(damaged[:30]) is None
    packages = spark.createDataFrame([("1", bytearray(tar({"m.tex": MAIN}))), ("2", bytearray(damaged)), ("3", bytearray(b"junk")), ("4", None), ("5", bytearray(b"\\documentclass{a} text"))], "arxiv_id string, payload binary")
    errors = {r.arxiv_id: r.error for r in extract.latex_tier(packages).collect()}
    assert errors == {"1": None, "2": "latex: damaged package", "3": "latex: no document", "4": "latex: no package", "5": "latex: no sections"}
    assert "\\input{a}" in extract.expand(loop["a.tex"], loop) and extract.expand("\\input{none}", {}) == "\\input{none}"
    got = spark.createDataFrame([(bytearray(tar({"m.tex": MAIN})),), (None,)], "p binary").select(extract.eprint_to_markdown(F.col("p")).alias("m")).collect()
    assert got[0].m.startswith("## First Part") and got[1].m is None


def test_cascade_and_archive(spark):
    d = lambda rows: spark.createDataFrame(rows, "arxiv_id string, markdown string, error string")
    echo = "## A\n\nA\n\n## B\n\nB\n\n## C\n\nC"
    html = d([("1", PROSE * 3, None), ("2", echo, None), ("3", None, "http 404")])
    tex = d([("1", "tex", None), ("2", "tex", None), ("3", None, "no sections")])
    got = {r.arxiv_id: (r.source, r.error) for r in extract.cascade([("html", html), ("latex", tex)]).collect()}
    assert got == {"1": ("html", None), "2": ("latex", None), "3": (None, "no sections")}
    rows = spark.createDataFrame([("1", "html", "text"), ("../x", "html", "t"), ("3", "html", None)], "arxiv_id string, source string, markdown string")
    out = {r.arxiv_id: r.zip for r in extract.archive(rows).collect()}
    assert zipfile.ZipFile(io.BytesIO(out["1"])).namelist() == ["1/1.md", "1/1.meta.json"] and out["../x"] is None and out["3"] is None
    assert [r.arxiv_id for r in extract.to_fetch(rows, rows.where("arxiv_id = '1'")).orderBy("arxiv_id").collect()] == ["../x", "3"]


def test_pdf_tier(spark):
    files = spark.createDataFrame([("1", bytearray(b"good")), ("2", bytearray(b"bad")), ("3", bytearray(b"short")), ("4", None)], "arxiv_id string, payload binary")

    def parser(raw):
        if raw == b"bad":
            raise RuntimeError("unreadable")
        return PROSE * 4 if raw == b"good" else "x"

    got = {r.arxiv_id: (r.markdown is not None, r.error) for r in extract.pdf_tier(files, parser).collect()}
    assert got == {"1": (True, None), "2": (False, "pdf: RuntimeError: unreadable"), "3": (False, "pdf: hardly any text"), "4": (False, "pdf: no file")}
    assert {r.error for r in extract.pdf_tier(files).collect()} == {"pdf: no parser", "pdf: no file"}


def test_stubs(spark):
    assert first(spark, "<p>Conversion is not available</p>", extract.is_stub) and first(spark, "<p>No HTML available</p>", extract.is_stub)
    assert not first(spark, "Conversion is not available" + "x" * 6000, extract.is_stub) and not first(spark, "<p>fine</p>", extract.is_stub)
