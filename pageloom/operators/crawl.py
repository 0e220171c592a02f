"""Breadth-first crawls over page tables, exact in order, depth and limit.

All crawls advance together, one level per step. A level is a narrow table
(``crawl``, ``seq``, ``url`` and a few counters); HTML is never touched. Each
level is written to the shared folder and read back, so lineage stays one step
long and an executor loss replays one level.

Sizes that follow from the rules and bound every group:

* at most 100 pages are queued or done per crawl, so a level has <= 100 rows
  per crawl;
* a failed page frees its place, so ``cap`` (places open when a page is read)
  takes at most 100 values per level, and under one ``cap`` only the first
  ``cap`` different links can be admitted: of those, the ones admitted earlier
  are already counted in the places taken. Ranking the candidates under each
  ``cap`` and keeping ``cap`` of them is therefore exact, and leaves at most
  100 x 100 rows per crawl and level for the ordered fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import markdown
from ..functions.requests import (
    MAX_DEPTH,
    MAX_LIMIT,
    clamp_crawl_limit,
    clamp_depth,
    metadata_map,
    omit_empty_list,
    resolve_mode,
    result_fields,
)
from ..functions.reuse import reuse
from ..functions.urls import explode_positions, hostname, is_parsable_url, key_of
from ..session import bound_batches, materialize_bucketed, materialize_counted
from .images import image_arrays
from .links import page_links
from .pages import (
    DYNAMIC,
    ENGINE_NAMES,
    NOT_FOUND,
    STATIC,
    _dynamic_error,
    _static_columns,
    _with_id,
    asked_pages,
    choice_for,
    chosen_page_id,
    documents_of,
    index_of,
    missing_errors,
    with_page_key,
)

OUTPUT = ("crawl_id", "seq", "url", "depth", "parent_seq", "engine", "error", "page_id")
#: A link belongs to one snapshot of a page.
LINK_KEYS = ["page_key", "engine", "page_id"]
#: Hosts that may be broadcast (some megabytes).
FEW_HOSTS = 100_000
_SPEC = ("url", "mode", "screenshot", "maxDepth", "limit")


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Defaults and caps applied, mode resolved, seed turned into its key.
    Optional columns may be missing."""

    def optional(name, kind):
        return F.col(name) if name in jobs.columns else F.lit(None).cast(kind)

    return jobs.select(
        "crawl_id",
        key_of("url").alias("url"),
        resolve_mode(optional("render", "boolean"), optional("mode", "string")).alias("mode"),
        F.coalesce(optional("screenshot", "boolean"), F.lit(False)).alias("screenshot"),
        clamp_depth(optional("maxDepth", "int")).cast("int").alias("maxDepth"),
        clamp_crawl_limit(optional("limit", "int")).cast("int").alias("limit"),
        F.coalesce(optional("cancelled", "boolean"), F.lit(False)).alias("cancelled"),
    )


def _visit(frontier: DataFrame, index: DataFrame, missing: tuple[str, str]) -> DataFrame:
    """Outcome of every frontier page and the places open when it is read."""
    found = frontier.join(index, frontier.url == index.page_key, "left")
    bad_seed = (F.col("depth") == 0) & ~is_parsable_url(F.col("url"))
    chosen = found.withColumn("_choice", choice_for(*missing)).select(
        *frontier.columns,
        F.col("_choice.engine").alias("engine"),
        F.when(bad_seed, F.format_string('invalid seed URL "%s"', "url"))
        .otherwise(F.col("_choice.error"))
        .alias("error"),
        chosen_page_id().alias("page_id"),
    )
    return chosen.withColumns(_counters())


@reuse
def _counters() -> dict:
    """Places open before each page, pages done after the level, and which row
    leads its crawl."""
    crawl = Window.partitionBy("spec_id")
    before = crawl.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("error").isNotNull().cast("int")
    queued_and_done = F.count(F.lit(1)).over(crawl).cast("int") + F.col("done")
    return {
        "cap": F.col("limit") - queued_and_done + F.coalesce(F.sum(failed).over(before), F.lit(0)).cast("int"),
        "done_after": F.col("done") + F.sum(1 - failed).over(crawl).cast("int"),
        "last_seq": F.max("seq").over(crawl),
        "leads": F.col("seq") == F.min("seq").over(crawl),
    }


def _admit(level: DataFrame, links: DataFrame, visited: DataFrame) -> DataFrame:
    """Next frontier: links of the level's pages in page and link order, each
    admitted once and only while a place is open. The depth is read from the
    rows, so every level runs the same generated code."""
    # bucketed links are joined on exactly the keys they are bucketed by
    open_pages = level.filter(
        F.col("error").isNull() & (F.col("depth") < F.col("maxDepth")) & (F.col("cap") > 0)
    ).select("spec_id", "seq", "cap", F.col("url").alias("page_key"), "engine", "page_id")
    candidates = open_pages.join(links, LINK_KEYS).select(
        "spec_id", "cap", "seq", "pos", F.col("link_norm").alias("url")
    )
    fresh = candidates.join(visited, ["spec_id", "url"], "left_anti")
    # A later copy under the same cap cannot succeed where the first did not.
    firsts = fresh.groupBy("spec_id", "url", "cap").agg(F.min(F.struct("seq", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("spec_id", "cap").orderBy("at"))
    kept = firsts.withColumn("rank", rank).filter(F.col("rank") <= MAX_LIMIT).filter(F.col("rank") <= F.col("cap"))
    ordered = kept.groupBy("spec_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at.seq"), F.col("at.pos"), "url", "cap"))).alias("found")
    )
    folded = ordered.select("spec_id", _fold().alias("admitted"))
    admitted = explode_positions(folded, ["spec_id"], "admitted", "next")
    state = level.filter("leads").select(
        "spec_id",
        "mode",
        "screenshot",
        "maxDepth",
        "limit",
        (F.col("depth") + 1).alias("depth"),
        F.col("done_after").alias("done"),
        "last_seq",
    )
    return admitted.join(state, "spec_id").select(
        "spec_id",
        (F.col("last_seq") + 1 + F.col("pos")).cast("int").alias("seq"),
        F.col("next.url").alias("url"),
        "depth",
        F.col("next.parent_seq").alias("parent_seq"),
        "mode",
        "screenshot",
        "maxDepth",
        "limit",
        "done",
    )


@reuse
def _fold():
    """Candidates in order, each taken while a place is open and unless taken."""
    nothing = F.array().cast("array<struct<url:string,parent_seq:int>>")

    def take(taken, link):
        full = F.size(taken) >= link.cap
        seen = F.exists(taken, lambda t: t.url == link.url)
        entry = F.struct(link.url.alias("url"), link.seq.alias("parent_seq"))
        return F.when(full | seen, taken).otherwise(F.array_append(taken, entry))

    return F.aggregate("found", nothing, take)


def crawl(
    jobs: DataFrame,
    index: DataFrame,
    links: DataFrame,
    include_patterns: tuple[str, ...] = (),
    exclude_patterns: tuple[str, ...] = (),
    missing: tuple[str, str] = (NOT_FOUND, NOT_FOUND),
) -> DataFrame:
    """Pages of every crawl in visiting order.

    ``index`` and ``links`` come from ``crawl_graph`` (or from ``page_index`` and
    ``crawl_links``, kept as tables). Returns ``crawl_id, seq, url, depth,
    parent_seq, engine, error, page_id``. Jobs that ask for the same crawl are computed once. Runs
    up to ``maxDepth + 1`` steps, each writing one narrow level.

    Patterns limit which links may be followed; with include patterns a link
    must match one of them. ``missing`` holds the errors for a URL without
    snapshot, static and dynamic.
    """
    for pattern in exclude_patterns:
        links = links.filter(~F.col("link_norm").rlike(pattern))
    if include_patterns:
        links = links.filter(F.col("link_norm").rlike("|".join(f"(?:{p})" for p in include_patterns)))

    asked = normalize_jobs(jobs)
    wanted = asked.filter(~F.col("cancelled"))
    specs = (
        wanted.select(*_SPEC).distinct().withColumn("spec_id", F.sha2(F.to_json(F.struct(*_SPEC)), 256))
    )
    frontier = specs.select(
        "spec_id",
        F.lit(0).alias("seq"),
        "url",
        F.lit(0).alias("depth"),
        F.lit(None).cast("int").alias("parent_seq"),
        "mode",
        "screenshot",
        "maxDepth",
        "limit",
        F.lit(0).alias("done"),
    )
    levels: list[DataFrame] = []
    for depth in range(MAX_DEPTH + 1):
        level, rows = materialize_counted(_visit(frontier, index, missing), f"crawl-level-{depth}")
        if rows == 0:
            break
        levels.append(level)
        visited = _union(levels).select("spec_id", "url")
        frontier = _admit(level, links, visited)
    if not levels:
        levels = [level]
    pages = _union(levels).select("spec_id", *OUTPUT[1:])
    ids = wanted.withColumn("spec_id", F.sha2(F.to_json(F.struct(*_SPEC)), 256)).select("crawl_id", "spec_id")
    return ids.join(pages, "spec_id").select(*OUTPUT)


def _hosted(table: DataFrame | None, hosts: DataFrame | None) -> DataFrame | None:
    if table is None or hosts is None:
        return table
    hosted = table.withColumn("_host", hostname(F.col("page_key")))
    return hosted.join(hosts, "_host", "left_semi").drop("_host")


def _read_pages(pages: DataFrame | None, rendered: DataFrame | None, hosts: DataFrame | None) -> DataFrame:
    """What a crawl needs of every snapshot, from one reading of its HTML:
    ``page_key, engine, page_id, error, needs_dynamic, norms``."""
    keys = ["page_key", "engine", "page_id", "error", "needs_dynamic"]
    parts = []
    if pages is not None:
        kept = _hosted(with_page_key(pages), hosts)
        flags = dict(zip(("error", "needs_dynamic"), _static_columns()[2:]))
        parts.append(page_links(kept.withColumns({"engine": F.lit(STATIC), **flags}), "page_key", keys))
    if rendered is not None:
        kept = _hosted(with_page_key(_with_id(rendered)), hosts)
        flags = {"error": _dynamic_error(), "needs_dynamic": F.lit(False)}
        parts.append(page_links(kept.withColumns({"engine": F.lit(DYNAMIC), **flags}), "page_key", keys))
    return _union(parts)


def crawl_graph(
    pages: DataFrame | None, rendered: DataFrame | None = None, jobs: DataFrame | None = None, few_hosts: int = FEW_HOSTS
) -> tuple[DataFrame, DataFrame]:
    """Page index and links for ``crawl``, as tables bucketed by the keys a crawl
    joins on, so that each level moves its frontier only.

    Each snapshot's HTML is read once. With ``jobs``, only snapshots on the hosts
    of their seeds count, as no crawl leaves these. Up to ``few_hosts`` hosts are
    broadcast and the HTML of other pages is never read; beyond that number
    hosts meet what was read of the pages, without their HTML.
    """
    hosts, broadcast = None, False
    if jobs is not None:
        hosts = normalize_jobs(jobs).select(hostname(F.col("url")).alias("_host")).distinct()
        hosts, count = materialize_counted(hosts, "crawl-hosts")
        broadcast = count <= few_hosts
    read = _read_pages(pages, rendered, F.broadcast(hosts) if broadcast else None)
    if hosts is not None and not broadcast:
        read = _hosted(read, hosts)
    read, rows = materialize_counted(read, "crawl-pages")
    static, dynamic = read.filter(F.col("engine") == STATIC), read.filter(F.col("engine") == DYNAMIC)
    static = static.select(
        "page_key", F.col("page_id").alias("static_id"), F.col("error").alias("static_error"), "needs_dynamic"
    )
    dynamic = dynamic.select("page_key", F.col("page_id").alias("dynamic_id"), F.col("error").alias("dynamic_error"))
    index = index_of(None if pages is None else static, None if rendered is None else dynamic)
    index = materialize_bucketed(index, "page-index", ["page_key"], rows)
    total = read.agg(F.sum(F.size("norms"))).first()[0] or 0
    links = explode_positions(read, LINK_KEYS, "norms", "link_norm")
    return index, materialize_bucketed(links, "crawl-links", LINK_KEYS, total)


def crawl_site(jobs: DataFrame, pages: DataFrame | None, rendered: DataFrame | None = None, **options) -> DataFrame:
    """``crawl`` straight from page tables, over a ``crawl_graph`` of the hosts of
    the seeds."""
    index, links = crawl_graph(pages, rendered, jobs)
    return crawl(jobs, index, links, missing=missing_errors(pages, rendered), **options)


def crawl_documents(
    crawl_pages: DataFrame,
    jobs: DataFrame,
    pages: DataFrame | None,
    rendered: DataFrame | None = None,
    as_of: Column | None = None,
    max_images: int = 10,
) -> DataFrame:
    """One document per crawl: ``crawl_id`` and the fields of a crawl result, its
    pages as result envelopes in visiting order, its failures with their errors.

    The payload of a page is made once, however many crawls visited it, and
    attached in the last join. A crawl holds at most 100 pages, which bounds a
    document. ``as_of`` gives the time of the results, NULL leaves it out;
    images are part of the results of jobs with ``images``.
    """
    bound_batches(crawl_pages.sparkSession)
    ok = crawl_pages.filter(F.col("error").isNull())
    needed = ok.select(F.col("url").alias("page_key"), "engine", "page_id").distinct()
    keys = needed.select("page_key")
    found = documents_of(needed, asked_pages(pages, keys), asked_pages(rendered, keys))
    converted = found.withColumn("markdown", markdown(F.col("html")))
    payload = image_arrays(converted, ["page_key", "engine", "html", "markdown"], max_images, base="page_key")
    names = F.create_map(*[F.lit(x) for pair in ENGINE_NAMES.items() for x in pair])
    metadata = metadata_map(F.lit(None).cast("timestamp") if as_of is None else as_of, F.element_at(names, F.col("engine")))
    payload = payload.withColumn("metadata", F.map_filter(metadata, lambda _, value: value.isNotNull()))
    summary = crawl_summary(crawl_pages, jobs, payload)
    wants = F.coalesce(F.col("images"), F.lit(False)) if "images" in jobs.columns else F.lit(False)
    asked = summary.join(jobs.select("crawl_id", wants.alias("_images")), "crawl_id")

    def envelope(page: Column) -> Column:
        return result_fields(page.url, page.markdown, page.html, page.metadata, F.when(F.col("_images"), page.images))

    return asked.select(
        "crawl_id",
        "status",
        "total",
        "maxDepth",
        "limit",
        F.transform("data", envelope).alias("data"),
        omit_empty_list(F.col("failedUrls")).alias("failedUrls"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def crawl_status_of(total, failures, cancelled):
    """cancelled > failed > partial > completed."""
    return (
        F.when(cancelled, F.lit("cancelled"))
        .when((failures > 0) & (total == 0), F.lit("failed"))
        .when(failures > 0, F.lit("partial"))
        .otherwise(F.lit("completed"))
    )


def crawl_summary(crawl_pages: DataFrame, jobs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per crawl: status, counts, pages and failures in order.

    ``documents(page_key, engine, ...)`` adds result fields to ``data``. A
    crawl holds at most 100 pages, which bounds the collected lists.
    """
    ok = F.col("error").isNull()
    pages = crawl_pages
    fields = [F.col("seq"), F.col("url")]
    if documents is not None:
        extra = [c for c in documents.columns if c not in ("page_key", "engine")]
        body = documents.withColumnRenamed("page_key", "url")
        pages = pages.join(body, ["url", "engine"], "left")
        fields += [F.col(c) for c in extra]
    grouped = pages.groupBy("crawl_id").agg(
        F.count_if(ok).cast("int").alias("total"),
        F.count_if(~ok).cast("int").alias("failures"),
        F.array_sort(F.collect_list(F.when(ok, F.struct(*fields))), lambda a, b: a.seq - b.seq).alias("data"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("seq", "url", "error")))).alias("failedUrls"),
    )
    joined = normalize_jobs(jobs).select("crawl_id", "maxDepth", "limit", "cancelled").join(grouped, "crawl_id", "left")
    total, failures = (F.coalesce(F.col(c), F.lit(0)) for c in ("total", "failures"))
    return joined.select(
        "crawl_id",
        crawl_status_of(total, failures, F.col("cancelled")).alias("status"),
        total.alias("total"),
        "maxDepth",
        "limit",
        F.transform("data", lambda d: d.dropFields("seq")).alias("data"),
        F.transform("failedUrls", lambda d: d.dropFields("seq")).alias("failedUrls"),
    )


def explode_results(summaries: DataFrame) -> DataFrame:
    """Nested crawl documents back to rows; failures carry their error."""
    done = summaries.select("crawl_id", F.posexplode("data").alias("pos", "d")).select(
        "crawl_id", "pos", F.col("d.url").alias("url"), F.lit(None).cast("string").alias("error")
    )
    failed = summaries.select("crawl_id", F.posexplode("failedUrls").alias("pos", "f")).select(
        "crawl_id", "pos", F.col("f.url").alias("url"), F.col("f.error").alias("error")
    )
    return done.unionByName(failed)


def crawl_page(crawl_pages: DataFrame, summaries: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One batch of every crawl's pages with progress. Ranks are dense per
    crawl and a crawl is small, so the window needs no global order."""
    limit = max(1, min(limit, 100))
    rank = F.row_number().over(Window.partitionBy("crawl_id").orderBy("seq")) - 1
    batch = (
        crawl_pages.filter(F.col("error").isNull())
        .withColumn("rank", rank)
        .filter((F.col("rank") >= offset) & (F.col("rank") < offset + limit))
        .groupBy("crawl_id")
        .agg(F.count(F.lit(1)).cast("int").alias("returned"), F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("p"))
    )
    joined = summaries.select("crawl_id", "status", "total", "limit").join(batch, "crawl_id", "left")
    returned = F.coalesce(F.col("returned"), F.lit(0))
    return joined.select(
        "crawl_id",
        "status",
        F.col("total").alias("pages_crawled"),
        F.least(F.lit(100), F.floor(F.col("total") * 100 / F.col("limit"))).cast("int").alias("progress"),
        returned.alias("returned"),
        (F.lit(offset) + returned).alias("next_offset"),
        F.transform("p", lambda x: x.url).alias("pages"),
    )
