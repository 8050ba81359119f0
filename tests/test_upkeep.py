import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscan import config, schema
from folioscan.api import VERBS, Engine
from folioscan.operators import encode, incremental, jobs
from folioscan.sources import index_store, shards
from folioscan.sources.index_store import IndexStore
from folioscan.streaming.refresh import is_stale, refresh_stream

T0 = datetime(2025, 1, 1)


def record(title="T", **more):
    return {"title": title, "abstract": "A", "authors": ["x"], "comment": "dropped", "tags": ["t"], **more}


def write(folder, name, papers):
    (folder / "data").mkdir(parents=True, exist_ok=True)
    (folder / "data" / name).write_text(papers if isinstance(papers, str) else json.dumps(papers))


def test_shards_merge(spark, tmp_path):
    write(tmp_path / "a", "papers-2025-03.json", {"1": record(" one "), "2": record("two", tags=None, authors=None)})
    write(tmp_path / "a", "papers-2025-04.json", {"1": record("one again")})
    write(tmp_path / "a", "papers-2025-05.json", "{broken")
    write(tmp_path / "a", "other.json", {"9": record()})
    write(tmp_path / "b", "papers-2025-03.json", {"2": record("two b"), "3": record(None)})
    feeds = [shards.Feed("chemistry", path=str(tmp_path / "a")), shards.Feed("physics", path=str(tmp_path / "b")), shards.Feed("none", path=str(tmp_path / "missing"))]
    got = {r.arxiv_id: (r.title, r.domain) for r in shards.load_all(spark, feeds).collect()}
    assert got == {"1": ("one again", "chemistry,chemistry"), "2": ("two b", "chemistry,physics"), "3": ("", "physics")}
    once = {r.arxiv_id: r.domain for r in shards.load_all(spark, feeds, dedup_domains=True).collect()}
    assert once["1"] == "chemistry"
    two = shards.load_feed(spark, feeds[0]).where("arxiv_id = '2'").first()
    assert two.tags == [] and two.authors == [] and "comment" not in two.asDict()
    with pytest.raises(ValueError):
        shards.load_feed(spark, shards.Feed("x", path=None))
    with pytest.raises(ValueError):
        shards.load_feed(spark, shards.Feed("x", type="ftp", path="p"))
    assert shards.is_shard("papers-2025-03.json") and not shards.is_shard("papers.txt")


def test_landing_marker(tmp_path):
    folder = tmp_path / "land"
    shards.prepare_landing(folder, repo="r", branch="main")
    (folder / "papers-1.json").write_text("{}")
    shards.prepare_landing(folder, repo="r", branch="main")
    assert (folder / "papers-1.json").exists()
    shards.prepare_landing(folder, repo="r", branch="dev")
    assert not (folder / "papers-1.json").exists()


def statuses(spark, sources, indexed):
    s = spark.createDataFrame(sources, "arxiv_id string, mtime timestamp")
    i = spark.createDataFrame(indexed, "arxiv_id string, indexed_at timestamp")
    return incremental.classify(s, i)


def test_classify_and_strategy(spark):
    st = statuses(spark, [("new", T0), ("same", T0 + timedelta(seconds=1)), ("late", T0 + timedelta(seconds=2)), ("unknown", T0)], [("same", T0), ("late", T0), ("unknown", None), ("gone", T0)])
    assert {r.arxiv_id: r.status for r in st.collect()} == {"new": "new", "same": "unchanged", "late": "changed", "unknown": "changed", "gone": "deleted"}
    assert incremental.strategy(st) == "mixed" and incremental.strategy(st, same_model=False) == "full" and incremental.strategy(st, incremental=False) == "full"
    assert incremental.strategy(st.where("status in ('new', 'unchanged')")) == "append" and incremental.strategy(st.where("status = 'unchanged'")) == "noop"
    index = spark.createDataFrame([("same", 1), ("late", 1), ("gone", 1)], "arxiv_id string, v int")
    merged = incremental.merge_index(index, st, spark.createDataFrame([("late", 2), ("new", 2)], "arxiv_id string, v int"))
    assert {(r.arxiv_id, r.v) for r in merged.collect()} == {("same", 1), ("late", 2), ("new", 2)}


def test_refresh(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "arxiv_id string")
    calls = []

    def make(rows):
        calls.append(sorted(r.arxiv_id for r in rows.collect()))
        return rows.select("arxiv_id", F.array(F.lit(1.0)).alias("embedding"))

    index = make(ids("a", "b"))
    calls.clear()
    assert incremental.refresh(ids("a", "b"), ids("a", "b"), index, make)[1] == {"strategy": "noop", "added": 0, "deleted": 0} and calls == []
    out, said = incremental.refresh(ids("a", "b"), ids("a", "b", "c"), index, make)
    assert said == {"strategy": "incremental", "added": 1, "deleted": 0} and calls == [["c"]] and out.count() == 3
    assert incremental.refresh(ids("a", "b"), ids("b"), index, make)[1]["strategy"] == "full"
    assert incremental.refresh(ids("a"), ids("a"), None, make)[1]["strategy"] == "full"


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    assert store.version() is None and store.load() is None
    for n in range(1, 4):
        assert store.save(spark.range(n)) == n
    store.drop_old()
    assert store.load().count() == 3 and sorted(p.name for p in (tmp_path / "ix").glob("v=*")) == ["v=2", "v=3"]
    with pytest.raises(Exception):
        store.save(spark.range(1).select(F.raise_error(F.lit("x")).alias("x")))
    assert store.load().count() == 3 and store.version() == 3
    assert store.save(spark.range(7), {"model": "m"}) == 5 and store.load().count() == 7 and store.meta() == {"model": "m"}  # the failed one's number stays free
    store.append(spark.range(2))
    assert store.load().count() == 9


def test_two_writers_of_an_index(spark, tmp_path):
    a, b = (IndexStore(spark, str(tmp_path / "ix")) for _ in range(2))
    a.save(spark.range(1))

    class Slow:
        """Rows whose writing another writer overtakes."""

        @property
        def write(self):
            assert b.save(spark.range(3)) == 3
            return spark.range(2).write

    with pytest.raises(RuntimeError):
        a.save(Slow())
    assert a.load().count() == 3 and a.version() == 3


def test_lock_has_an_owner(spark, tmp_path, monkeypatch):
    a, b = (IndexStore(spark, str(tmp_path)) for _ in range(2))
    assert a.lock("a") and not b.lock("b") and a.locked() == "a"
    b.unlock("b")
    assert b.locked() == "a"
    monkeypatch.setattr(index_store, "LOCK_SECONDS", 0.0)
    assert b.locked() is None and b.lock("b")  # what is not renewed is taken over
    monkeypatch.setattr(index_store, "LOCK_SECONDS", 60.0)
    a.renew("a")
    a.unlock("a")
    assert a.locked() == "b"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "1"), ("b", "2")], "arxiv_id string, text string").write.parquet(str(tmp_path / "in" / "p1.parquet"))
    store = IndexStore(spark, str(tmp_path / "ix"))
    make = lambda d: d.select("arxiv_id", "text")

    def run():
        stream = spark.readStream.schema("arxiv_id string, text string").parquet(str(tmp_path / "in" / "*.parquet"))
        refresh_stream(spark, stream, store, make, str(tmp_path / "cp")).awaitTermination()

    run()
    spark.createDataFrame([("b", "3"), ("c", "4")], "arxiv_id string, text string").write.parquet(str(tmp_path / "in" / "p2.parquet"))
    run()
    assert {(r.arxiv_id, r.text) for r in store.load().collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert is_stale(None, 0, 1) and is_stale(0, 3601, 1) and not is_stale(0, 3600, 1)


def test_jobs(spark):
    rows = [("a", 1, "fetch", "pending", T0), ("a", 2, "fetch", "done", T0 + timedelta(days=1)), ("b", 3, "fetch", "running", T0 + timedelta(days=2))]
    latest = jobs.latest(spark.createDataFrame(rows, "job_id string, seq long, kind string, state string, at timestamp"))
    assert {r.job_id: r.state for r in latest.collect()} == {"a": "done", "b": "running"}
    assert {r.job_id: r.state for r in jobs.recover(latest).collect()} == {"a": "done", "b": "orphaned"}
    assert [r.job_id for r in jobs.retain(latest, F.lit(T0 + timedelta(days=9))).collect()] == ["b"]
    assert [r.job_id for r in jobs.job_list(latest).collect()] == ["b", "a"]
    assert spark.range(1).select(jobs.progress(F.lit(0), F.lit(0)).alias("p")).first().p == 0


def test_encoder(spark):
    rows = spark.createDataFrame([("a", "x y z"), ("b", ""), ("c", None)], "arxiv_id string, text string")
    got = encode.encode_passages(rows, encode.HashingEncoder(16), bucketed=True).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 and len(r.embedding) == 16 for r in got)
    assert encode.encode_passages(rows.where("false"), encode.HashingEncoder()).count() == 0


def test_engine(spark, tmp_path):
    papers = spark.createDataFrame([("1", "Alpha study", "", [], "about alpha", "", [], "", "", "", [], ["t"], "d"), ("2", "Beta", "", [], "about beta", "", [], "", "", "", [], [], "d")], schema.PAPER)
    md = "# Alpha\n\n## Methods\n\n" + "alpha methods in detail. " * 10 + "\n\n## References\n\nalpha alpha alpha " + "reference text " * 10 + "\n\n## End\n\n" + "closing words here. " * 10
    html = spark.createDataFrame([("1", md, None)], "arxiv_id string, markdown string, error string")
    e = Engine(spark, papers, str(tmp_path), landed=[("html", html)])
    assert "error" in e.search_abstract_semantic("x").columns and "error" in e.search_paper_text("x").columns and "error" in e.fetch_papers([]).columns
    assert e.reindex().first().state == "failed"
    assert e.refresh_abstracts().first().state == "done" and e.search_abstract_semantic("alpha study", 1).first().arxiv_id == "1"
    assert [r.arxiv_id for r in e.similar_to_abstract("1").collect()] == ["2"]
    assert e.fetch_papers(["1", "2"]).first().state == "done" and [r.arxiv_id for r in e.list_enriched().collect()] == ["1"]
    fetched = {r.arxiv_id: r for r in e.fetch_results().collect()}
    assert fetched["2"].error == "html: no text" and fetched["2"].source is None and fetched["1"].error is None and fetched["1"].n_headings == 3 and fetched["1"].echo_skeleton is False
    done = [json.loads(r.result) for r in e.log.load().where("kind = 'fetch' and state = 'done'").collect()]
    assert [(d["n_ok"], d["n_failed"], d["failed"]) for d in done] == [(1, 1, ["2"])]
    assert e.reindex().first().state == "done"
    assert [r.section for r in e.search_paper_text("alpha", 5).collect()][-1] == "References"
    assert e.search_paper_semantic("alpha methods", 2).count() == 2 and e.similar_to_paper("1").count() == 0
    info = e.paper_info("1").first()
    assert info.enriched and info.indexed and info.n_chunks == 4
    assert {r.arxiv_id: r.status for r in e.validate_arxiv_ids(["1", "2"]).collect()} == {"1": "cached", "2": "pdf_fallback"}
    assert e.job_list().count() == 4 and "error" in e.job_status("none").columns
    assert e.guard.lock("other") and e.reindex().first().skipped == "encoder busy" and e.refresh_abstracts().first().skipped == "encoder busy"
    e._event("lost", "fetch", "running")
    again = Engine(spark, papers, str(tmp_path))
    assert again.job_status("lost").first().state == "orphaned" and again.guard.locked() == "other"  # a live lock stays
    e.guard.unlock("other")
    assert e.guard.lock(e.owner)
    e._event("mine", "reindex", "running")
    assert Engine(spark, papers, str(tmp_path)).job_status("mine").first().state == "running"  # its engine is alive
    e.guard.unlock(e.owner)
    assert Engine(spark, papers, str(tmp_path)).job_status("mine").first().state == "orphaned"
    e._event("mine", "reindex", "done")
    later = Engine(spark, papers, str(tmp_path), clock=lambda: datetime.now(UTC) + timedelta(days=8))
    assert later.job_list().count() == 0  # what ended long ago goes at start
    other = Engine(spark, papers, str(tmp_path), encoder=encode.HashingEncoder(32), landed=[("html", html)])
    assert "not hashing (32)" in other.search_paper_semantic("x").first().error and "not hashing (32)" in other.search_abstract_semantic("x").first().error
    assert other.reindex().first().state == "done" and other.search_paper_semantic("alpha", 1).count() == 1 and other.chunks.meta()["dims"] == 32
    assert other.refresh_abstracts().first().state == "done" and other.search_abstract_semantic("alpha", 1).count() == 1
    assert len(VERBS) == 16 and e.call("list_domains").count() == 1
    assert "error" in e.call("_run").columns and "error" in e.call("list_tags", {"bad": 1}).columns and "error" in e.call("search_abstract_text", {"query": "a", "k": 0}).columns
    assert [[0, 1], [2], [3]] == encode.batches([5, 6, 600, 9000]) and [len(b) for b in encode.batches([1] * 130 + [3000] * 9)] == [64, 64, 2, 8, 1]


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "none"))
    monkeypatch.delenv(config.VARIABLE, raising=False)
    assert config.load().server.default_k == 10 and config.load("missing.toml") == config.Config()
    (tmp_path / "folioscan.toml").write_text('[server]\ndefault_k = 5\nother = 1\n[[sources]]\nname = "a"\ntype = "local"\npath = "p"\n')
    assert config.load().server.default_k == 5 and config.load().sources[0].name == "a"
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "gone.toml"))
    assert config.load() == config.Config()


def test_long_text_keeps_its_shard(spark, tmp_path):
    write(tmp_path, "papers-2025-03.json", {"1": record(" one "), "2": record(None, abstract="x" * 21_000_000)})
    rows = shards.scan(spark, str(tmp_path / "data"), "d", written=("title", "abstract")).selectExpr("arxiv_id", "title", "length(abstract)", "written_title")
    assert {tuple(r) for r in rows.collect()} == {("1", "one", 1, " one "), ("2", "", 21_000_000, None)}
    none = shards.scan(spark, str(tmp_path), "d", written=("title",))
    assert none.count() == 0 and dict(none.dtypes)["written_title"] == "string"
