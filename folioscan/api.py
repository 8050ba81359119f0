"""The engine's verbs over a corpus, its indexes and its jobs, with checked arguments and error rows."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schema
from folioscan.config import Config
from folioscan.functions import text as T
from folioscan.operators import chunking, encode, extract, facets, incremental, jobs, quality, search
from folioscan.sources import shards
from folioscan.sources.index_store import LOCK_SECONDS, IndexStore

LOG = logging.getLogger(__name__)
SOURCES = (
    "arxiv_id string, source string, markdown string, n_chars int, error string, n_chunks int, n_headings int, avg_body_len double, echo_skeleton boolean, "
    "images array<string>, mtime timestamp"
)
EVENTS = "job_id string, seq long, kind string, state string, at timestamp_ntz, result string, owner string, n_done int, n_total int"
#: The names that clients call and the bounds of their arguments.
VERBS = (
    "search_abstract_text", "search_abstract_semantic", "similar_to_abstract", "paper_info", "list_tags", "list_domains", "search_paper_text", "search_paper_semantic",
    "similar_to_paper", "fetch_papers", "reindex", "refresh_abstracts", "job_status", "job_list", "list_enriched", "validate_arxiv_ids",
)
#: Largest k of searches over abstracts and over full texts; bounds of a snippet.
ABSTRACT_K, FULLTEXT_K, SNIPPET = 200, 100, (80, 4000)


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= int(value) <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return int(value)


@dataclass
class Engine:
    """papers: PAPER rows; landed: full texts that may be fetched, by tier (arxiv_id, markdown, error); clock: the present, for tests.

    What was fetched is kept as SOURCES rows, failures among them. Jobs of an engine that shows no sign of life are orphaned.
    """

    spark: SparkSession
    papers: DataFrame
    root: str
    encoder: encode.Encoder = field(default_factory=encode.HashingEncoder)
    landed: list[tuple[str, DataFrame]] = field(default_factory=list)
    full_rebuild: bool = True
    default_k: int = 10
    clock: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config, root: str, landing: str | None = None, **more) -> Engine:
        """An engine over the configured feeds."""
        return cls(spark, shards.load_all(spark, list(config.sources), landing).drop("first"), root, full_rebuild=config.refresh.full_rebuild, default_k=config.server.default_k, **more)

    def __post_init__(self):
        store = lambda name: IndexStore(self.spark, f"{self.root}/{name}")
        self.abstracts, self.chunks, self.sources, self.log = store("abstracts"), store("chunks"), store("sources"), store("jobs")
        self.owner = uuid.uuid4().hex
        self._seq = time.time_ns()
        self.guard = IndexStore(self.spark, self.root)
        self.recover()

    # Helpers

    def _error(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "error string")

    def _fetched(self) -> DataFrame:
        """The last result of every paper that was fetched."""
        have = self.sources.load()
        return have if have is not None else self.spark.createDataFrame([], SOURCES)

    def _sources(self) -> DataFrame:
        """The papers whose full text is there."""
        return self._fetched().where("markdown is not null")

    def _now(self) -> datetime:
        return self.clock().astimezone(UTC).replace(tzinfo=None)

    def _event(self, job: str, kind: str, state: str, result: str | None = None, n_done: int | None = None, n_total: int | None = None) -> None:
        self._seq += 1
        row = [(job, self._seq, kind, state, self._now(), result, self.owner, n_done, n_total)]
        self.log.append(self.spark.createDataFrame(row, EVENTS))

    def recover(self) -> None:
        """At start: drop jobs that ended long ago, and orphan what still runs by the log unless its engine holds a lock that it renews."""
        events = self.log.load()
        if events is None:
            return
        live = self.guard.locked()
        last = jobs.latest(events).join(events.groupBy("job_id").agg(F.max_by("owner", "seq").alias("owner")), "job_id")
        kept = jobs.retain(last, F.lit(self._now()).cast("timestamp_ntz"))
        if live is None:  # nobody writes, so the log can be put together anew
            self.log.save(events.join(kept.select("job_id"), "job_id", "left_semi").coalesce(1))
            self.log.drop_old()
        for r in kept.where(F.col("state").isin(*jobs.ACTIVE) & ~F.col("owner").eqNullSafe(F.lit(live or None))).select("job_id", "kind").collect():
            self._event(r.job_id, r.kind, "orphaned")

    def _alone(self, kind: str, work) -> DataFrame:
        """Run what writes, unless another such job runs; the lock is renewed while it does."""
        if not self.guard.lock(self.owner):
            return self.spark.createDataFrame([("encoder busy",)], "skipped string")
        over = threading.Event()

        def beat() -> None:
            while not over.wait(LOCK_SECONDS / 4):
                self.guard.renew(self.owner)

        pulse = InheritableThread(target=beat, daemon=True)
        pulse.start()
        try:
            return self._run(kind, work)
        finally:
            over.set()
            pulse.join()
            self.guard.unlock(self.owner)

    def _run(self, kind: str, work) -> DataFrame:
        job = uuid.uuid4().hex
        self._event(job, kind, "running")
        try:
            result = work(lambda done, total: self._event(job, kind, "running", n_done=done, n_total=total))
        except Exception as e:  # a failed job is a state, not a crash
            LOG.exception("%s failed", kind)
            self._event(job, kind, "failed", str(e)[:500])
            return self.job_status(job)
        self._event(job, kind, "done", str(result))
        return self.job_status(job)

    def _unlike(self, index: IndexStore) -> str | None:
        """Why an index cannot be searched with this engine's encoder, or None."""
        made = index.meta()
        if made and (made.get("model"), made.get("dims")) != (self.encoder.name, self.encoder.dims):
            return f"the index was made with {made.get('model')} ({made.get('dims')}), not {self.encoder.name} ({self.encoder.dims})"
        return None

    def _made_with(self) -> dict:
        return {"model": self.encoder.name, "dims": self.encoder.dims, "max_seq_length": chunking.MAX_TOKENS, "at": self._now().isoformat()}

    # Abstracts

    def search_abstract_text(self, query: str, k: int | None = None, domain: str | None = None, tag: str | None = None) -> DataFrame:
        return search.search_text(self.papers, query, bounded("k", self.default_k if k is None else k, 1, ABSTRACT_K), domain, tag)

    def search_abstract_semantic(self, query: str, k: int | None = None, domain: str | None = None, tag: str | None = None) -> DataFrame:
        index = self.abstracts.load()
        if index is None:
            return self._error("there is no abstract index yet; run refresh_abstracts")
        if unlike := self._unlike(self.abstracts):
            return self._error(unlike)
        return search.search_semantic(self.papers, index, encode.encode_query(self.encoder, query), bounded("k", self.default_k if k is None else k, 1, ABSTRACT_K), domain, tag)

    def similar_to_abstract(self, arxiv_id: str, k: int | None = None) -> DataFrame:
        index = self.abstracts.load()
        if index is None:
            return self._error("there is no abstract index yet; run refresh_abstracts")
        return search.similar_to_abstract(self.papers, index, arxiv_id, bounded("k", self.default_k if k is None else k, 1, ABSTRACT_K))

    def paper_info(self, arxiv_id: str, full_abstract: bool = False) -> DataFrame:
        chunks = self.chunks.load()
        known = chunks if chunks is not None else self.spark.createDataFrame([], "arxiv_id string")
        return facets.paper_info(self.papers, arxiv_id, full_abstract, self._sources(), known)

    def list_tags(self, domain: str | None = None, min_count: int = 1, prefix: str | None = None, head_limit: int | None = None) -> DataFrame:
        return facets.list_tags(self.papers, domain, min_count, prefix, None if head_limit is None else bounded("head_limit", head_limit, 1, 1000))

    def list_domains(self) -> DataFrame:
        return facets.list_domains(self.papers)

    # Full texts

    def search_paper_text(self, query: str, k: int | None = None, snippet_chars: int = 240) -> DataFrame:
        chunks = self.chunks.load()
        if chunks is None:
            return self._error("there is no chunk index yet; run reindex")
        return search.search_chunks_text(chunks, query, bounded("k", self.default_k if k is None else k, 1, FULLTEXT_K), bounded("snippet_chars", snippet_chars, *SNIPPET)).drop("row")

    def search_paper_semantic(self, query: str, k: int | None = None, snippet_chars: int = 240) -> DataFrame:
        chunks = self.chunks.load()
        if chunks is None:
            return self._error("there is no chunk index yet; run reindex")
        if unlike := self._unlike(self.chunks):
            return self._error(unlike)
        vectors = chunks.select("row", "section", "embedding")
        return search.search_chunks_semantic(chunks.drop("embedding"), vectors, encode.encode_query(self.encoder, query), bounded("k", self.default_k if k is None else k, 1, FULLTEXT_K), bounded("snippet_chars", snippet_chars, *SNIPPET)).drop("row")

    def similar_to_paper(self, arxiv_id: str, k: int | None = None) -> DataFrame:
        chunks = self.chunks.load()
        if chunks is None:
            return self._error("there is no chunk index yet; run reindex")
        return search.similar_to_paper(chunks, arxiv_id, bounded("k", self.default_k if k is None else k, 1, FULLTEXT_K))

    def list_enriched(self) -> DataFrame:
        return facets.list_enriched(self._sources())

    def validate_arxiv_ids(self, arxiv_ids: list[str]) -> DataFrame:
        if not arxiv_ids:
            return self._error("no ids")
        asked = self.spark.createDataFrame([(i,) for i in arxiv_ids], "arxiv_id string")
        html = next((d for name, d in self.landed if name == "html"), self.spark.createDataFrame([], "arxiv_id string"))
        return facets.validate_ids(asked, html.select("arxiv_id"), self._sources())

    def fetch_papers(self, arxiv_ids: list[str], force: bool = False) -> DataFrame:
        """Take the landed full texts of these papers into the sources, the first tier that has one."""
        if not arxiv_ids:
            return self._error("no ids")

        def work(tell) -> str:
            have = self._fetched()
            asked = self.spark.createDataFrame([(i,) for i in arxiv_ids], "arxiv_id string")
            missing = extract.to_fetch(asked, have.where("markdown is not null"), force)
            tiers = [(n, missing.join(d.select("arxiv_id", "markdown", "error"), "arxiv_id", "left")) for n, d in self.landed]
            got = extract.cascade(tiers) if tiers else missing.select("arxiv_id", *(F.lit(None).cast(t).alias(n) for n, t in (("source", "string"), ("markdown", "string"), ("n_chars", "int"))), F.lit("nothing landed").alias("error"))
            made = chunking.chunk_markdown(got.where("markdown is not null")).groupBy("arxiv_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
            rows = quality.parse_quality(got).drop("branch").join(made, "arxiv_id", "left").withColumn("mtime", F.lit(self.clock()))
            rows = rows.withColumn("images", extract.image_refs(F.col("markdown"))).select(*have.columns)
            self.sources.save(have.join(missing, "arxiv_id", "left_anti").unionByName(rows))
            self.sources.drop_old()
            new = self._fetched().join(missing, "arxiv_id", "left_semi")
            said = facets.fetch_summary(new).first().asDict()
            tell(said["n_total"], said["n_total"])
            return json.dumps(said | {"by_source": {r.source: r.n for r in facets.fetch_breakdown(new).collect()}})

        return self._alone("fetch", work)

    def fetch_results(self) -> DataFrame:
        """The last result of every paper that was asked for: its source, counts and parse quality, or its error."""
        return self._fetched().drop("markdown")

    # Upkeep

    def reindex(self, incremental_: bool = True) -> DataFrame:
        def work(tell) -> str:
            have = self._sources()
            if have.isEmpty():
                raise FileNotFoundError("there are no sources to index")
            old = self.chunks.load()
            known = old.select("arxiv_id", "indexed_at") if old is not None else self.spark.createDataFrame([], "arxiv_id string, indexed_at timestamp")
            st = incremental.classify(have, known)
            kind = incremental.strategy(st, incremental=incremental_, same_model=self._unlike(self.chunks) is None, has_index=old is not None)
            if kind == "noop":
                return "noop"
            todo = have if kind == "full" else have.join(st.where("status in ('new', 'changed')").select("arxiv_id"), "arxiv_id", "left_semi")
            chunks = encode.encode_passages(chunking.chunk_markdown(todo), self.encoder, bucketed=True)
            order = F.concat_ws("/", F.rpad("arxiv_id", 64, " "), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
            fresh = chunks.withColumn("row", order).withColumn("indexed_at", F.lit(self.clock()))
            self.chunks.save(fresh if kind == "full" else incremental.merge_index(old, st, fresh.select(*old.columns)), self._made_with())
            self.chunks.drop_old()
            return kind

        return self._alone("reindex", work)

    def refresh_abstracts(self, new_papers: DataFrame | None = None, full: bool | None = None) -> DataFrame:
        """Take new papers and bring the abstract index up to them; without new papers, encode what is not in the index."""

        def work(tell) -> str:
            index = self.abstracts.load() if self._unlike(self.abstracts) is None else None  # another model's vectors are made anew
            new = new_papers if new_papers is not None else self.papers
            old = self.papers if new_papers is not None or index is None else index.select("arxiv_id")
            make = lambda p: encode.encode_passages(p.select("arxiv_id", T.search_text(F.col("title"), F.col("abstract")).alias("text")), self.encoder).drop("text")
            out, said = incremental.refresh(old, new, index, make, self.full_rebuild if full is None else full)
            if said["strategy"] != "noop":
                self.abstracts.save(out, self._made_with())
                self.abstracts.drop_old()
            self.papers = new
            return str(said)

        return self._alone("refresh", work)

    def _jobs(self) -> DataFrame:
        events = self.log.load()
        return jobs.latest(events if events is not None else self.spark.createDataFrame([], EVENTS))

    def job_status(self, job_id: str) -> DataFrame:
        found = self._jobs().where(F.col("job_id") == job_id)
        return self._error(f"there is no job {job_id}") if found.isEmpty() else found

    def job_list(self, limit: int = 50) -> DataFrame:
        return jobs.job_list(self._jobs(), bounded("limit", limit, 1, 500))

    def call(self, verb: str, arguments: dict | None = None) -> DataFrame:
        """A verb by name; unknown names and wrong arguments give a row with an error."""
        if verb not in VERBS:
            return self._error(f"unknown tool {verb}")
        try:
            return getattr(self, verb)(**(arguments or {}))
        except (TypeError, ValueError) as e:
            return self._error(str(e))
