"""Collection analytics: inventories, frontier transitions as batch transforms, archives and repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

STATES = ("pending", "in_progress", "done", "retry", "blocked", "gone", "excluded")


def merge_inventories(*inputs: DataFrame) -> DataFrame:
    """Union of inventories ``(source, category, url)``: the first input that lists a URL wins; column ``origin`` is its number."""
    every = reduce(DataFrame.unionByName, (df.select("source", "category", "url", F.lit(i).alias("origin")) for i, df in enumerate(inputs)))
    first = F.min(F.struct("origin", "source", "category"))
    return every.groupBy("url").agg(first.alias("f")).select("f.source", "f.category", "url", "f.origin")


def merge_report(merged: DataFrame, *inputs: DataFrame) -> DataFrame:
    """``(origin, rows, added, duplicates)`` of each input."""
    rows = reduce(DataFrame.unionByName, (df.agg(F.lit(i).alias("origin"), F.count("*").alias("rows")) for i, df in enumerate(inputs)))
    added = merged.groupBy("origin").agg(F.count("*").alias("added"))
    return rows.join(added, "origin", "left").select("origin", "rows", F.coalesce("added", F.lit(0)).cast("long").alias("added"), (F.col("rows") - F.coalesce("added", F.lit(0))).cast("long").alias("duplicates"))


def sample_inventory(inventory: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """At most ``n`` URLs of each source, by a seeded hash: the same draw on every run, in any partitioning.

    The cut by row number is a top-n per source, which Spark limits before the shuffle, so a hot source is no problem.
    """
    order = F.sha2(F.concat_ws(":", F.lit(seed), "url"), 256)
    by = W.partitionBy("source").orderBy("order", "url")
    return inventory.withColumn("order", order).withColumn("n", F.row_number().over(by)).where(F.col("n") <= n).drop("order", "n")


def insert_ignore(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The rows of ``fresh`` whose key is new, one per key."""
    return fresh.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def latest(rows: DataFrame, key: str, version: Column) -> DataFrame:
    """One row per key: the one of the highest version."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, version).alias("r")).select("r.*")


def due(now: int, revisit: bool = False) -> Column:
    """May a frontier row be claimed? Normal mode takes pending and retry rows, revisit mode done ones."""
    states = ("done",) if revisit else ("pending", "retry")
    return F.col("state").isin(*states) & (F.col("available_at") <= now)


def claim(frontier: DataFrame, now: int, per_source: int, cooldown: DataFrame | None = None) -> DataFrame:
    """The next tasks of every source, round-robin over the sources: column ``turn`` orders them.

    ``cooldown(source, until)`` keeps sources back that asked for a pause.
    """
    open_ = frontier.where(due(now))
    if cooldown is not None:
        resting = cooldown.groupBy("source").agg(F.max("until").alias("until")).where(F.col("until") > now)
        open_ = open_.join(resting, "source", "left_anti")
    turn = F.row_number().over(W.partitionBy("source").orderBy("available_at", "queue_order", "url"))
    return open_.withColumn("turn", turn).where(F.col("turn") <= per_source)


def transition(state: Column, response: Column, attempts: Column, max_attempts: int = 5) -> Column:
    """The state after an answer of that class."""
    failed = F.when(attempts + 1 >= max_attempts, "blocked").otherwise("retry")
    return (
        F.when(state != "in_progress", state).when(response.isin("valid", "redirect"), "done").when(response == "not_found", "gone")
        .when(response.isin("rate_limited", "server_error", "http_error", "empty", "anti_bot"), failed).otherwise("excluded")
    )


def fenced(answers: DataFrame, frontier: DataFrame) -> DataFrame:
    """``answers(url, lease_token, ...)`` with ``verdict``: only the holder of a row's lease may answer.

    ``accepted``, or why not: the row is not in progress (``no lease``), has been leased again (``lost lease``), or is
    ``unknown``.
    """
    held = frontier.select(F.col("url").alias("_url"), F.col("state").alias("_state"), F.col("lease_token").alias("_token"))
    verdict = (
        F.when(F.col("_url").isNull(), "unknown").when(F.col("_state") != "in_progress", "no lease")
        .when(F.col("_token").eqNullSafe(F.col("lease_token")) & F.col("_token").isNotNull(), "accepted").otherwise("lost lease")
    )
    return answers.join(held, F.col("url") == F.col("_url"), "left").withColumn("verdict", verdict).drop("_url", "_state", "_token")


def fence_generations(results: DataFrame, raw: DataFrame) -> DataFrame:
    """``results(url, generation, ...)`` of deferred parsing with ``verdict``: ``current`` if the raw page still has that
    generation, ``superseded`` if it has moved on, ``unknown`` without a raw page or ahead of it."""
    now = raw.select(F.col("url").alias("_url"), F.col("generation").alias("_now"))
    verdict = F.when(F.col("_now") == F.col("generation"), "current").when(F.col("_now") > F.col("generation"), "superseded").otherwise("unknown")
    return results.join(now, F.col("url") == F.col("_url"), "left").withColumn("verdict", verdict).drop("_url", "_now")


def recover(frontier: DataFrame, now: int) -> DataFrame:
    """Expired leases go back: rows in progress whose time has come become retries without a token."""
    lost = (F.col("state") == "in_progress") & (F.col("available_at") <= now)
    return frontier.withColumns({"state": F.when(lost, "retry").otherwise(F.col("state")), "lease_token": F.when(~lost, F.col("lease_token"))})


def changes(fetches: DataFrame, key: str, digest: Column, at: str) -> DataFrame:
    """Fetches in order with ``change``: new, changed or unchanged against the one before, and the ``generation`` so far."""
    by = W.partitionBy(key).orderBy(at)
    before = F.lag("_d").over(by)
    marked = fetches.withColumn("_d", digest).withColumn("change", F.when(before.isNull(), "new").when(before == F.col("_d"), "unchanged").otherwise("changed"))
    grown = F.sum(F.when(F.col("change") == "unchanged", 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("generation", grown).drop("_d")


def archive_eligible(raw: DataFrame, documents: DataFrame, active: DataFrame) -> DataFrame:
    """Raw pages that match their document in url, id, hash and generation, and are not being worked on."""
    keys = ["url", "raw_page_id", "content_sha256", "raw_generation"]
    return raw.join(documents.select(*keys), keys, "left_semi").join(active.select("url"), "url", "left_anti")


def inconsistent(raw: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose raw page is missing or has another hash."""
    return documents.join(raw.select("url", "content_sha256"), ["url", "content_sha256"], "left_anti")


def backfill_years(snapshot: DataFrame, database: DataFrame) -> DataFrame:
    """Years of a snapshot filled from a database by url and hash: the database's year if it knows one."""
    known = database.where("year <> 0").groupBy("url", "content_sha256").agg(F.max("year").alias("_y"))
    return snapshot.join(known, ["url", "content_sha256"], "left").withColumn("year", F.coalesce("_y", "year")).drop("_y")


def refresh_due(runs: DataFrame, now: int, ok_after: int, failed_after: int) -> DataFrame:
    """Sources whose sitemap is due: ``runs(source, finished_at, status)``, the latest run counts."""
    last = latest(runs, "source", F.col("finished_at"))
    at = F.col("finished_at") + F.when(F.col("status") == "failed", min(ok_after, failed_after)).otherwise(ok_after)
    return last.withColumn("due_at", at).withColumn("is_due", F.col("due_at") <= now)


def sitemap_requests(wanted: DataFrame, cache: DataFrame, now: int, ttl: int, recheck: int) -> DataFrame:
    """``wanted(url, lastmod, is_root)`` with ``action`` (``use`` the stored copy or ``fetch``), ``etag`` and ``last_modified``.

    ``cache(url, sha256, stored_sha256, checked_at, lastmod, hinted, etag, last_modified)`` has the stored copies; a copy
    whose content has another digest is none. A copy is used within ``ttl``, or within the longer ``recheck`` if its
    index names the same time of change; another time makes it stale at once. Roots are always asked for. What is
    fetched is asked for under the stored validators, so that 304 can answer.
    """
    c = cache.where(F.col("sha256") == F.col("stored_sha256")).select(F.col("url").alias("_url"), "checked_at", F.col("lastmod").alias("_lastmod"), "hinted", "etag", "last_modified")
    same = F.col("lastmod").eqNullSafe(F.col("_lastmod"))
    life = F.when(F.col("lastmod").isNotNull() & same & F.col("hinted"), recheck).otherwise(ttl)
    age = F.lit(now) - F.col("checked_at")
    fresh = ~F.col("is_root") & (ttl > 0) & (age >= 0) & (age < life) & (same | ~F.col("hinted"))
    joined = wanted.join(c, F.col("url") == F.col("_url"), "left")
    return joined.select(*wanted.columns, F.when(F.coalesce(fresh, F.lit(False)), "use").otherwise("fetch").alias("action"), "etag", "last_modified")


def sitemap_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """``requests`` of ``sitemap_requests`` that were fetched, with ``outcome`` of ``answers(url, status, valid)``: ``renewed``,
    ``not_modified`` (304 to a validator), or ``failed``, where the stored copy stays as it is."""
    a = answers.select(F.col("url").alias("_url"), "status", "valid")
    asked = F.col("etag").isNotNull() | F.col("last_modified").isNotNull()
    outcome = F.when((F.col("status") == 304) & asked, "not_modified").when((F.col("status") == 200) & F.col("valid"), "renewed").otherwise("failed")
    return requests.where("action = 'fetch'").join(a, F.col("url") == F.col("_url"), "left").withColumn("outcome", outcome).drop("_url", "status", "valid")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path)`` with ``allowed``: the longest rule ``(host, prefix, allow)`` of the host that the path begins
    with decides, allowing rules first among equals; without one, allowed."""
    fits = urls.select("host", "path").distinct().join(rules.select(F.col("host").alias("_h"), "prefix", "allow"), (F.col("host") == F.col("_h")) & F.col("path").startswith(F.col("prefix")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("allow"))).alias("b"))
    return urls.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("b.allow", F.lit(True))).drop("b")


def expand_sitemaps(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``(url, depth)`` reachable from ``roots(url)`` over ``links(parent, url)``, each at its smallest depth.

    Maps seen before end a path, so that loops are harmless and any depth is reached. Every level is checkpointed into
    the folder that the executors share.
    """
    shared_dir(roots.sparkSession)
    seen = front = roots.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    depth = 0
    while not front.isEmpty():
        depth += 1
        below = links.join(front.select(F.col("url").alias("parent")), "parent").select("url").distinct()
        front = below.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        seen = seen.unionByName(front)
        if depth % 20 == 0:
            seen = seen.checkpoint()
    return seen


def zip_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join that fails if either side lacks a key or has one twice."""
    r = right.withColumn("_right", F.lit(1))
    both = left.withColumn("_left", F.lit(1)).join(r, key, "full").withColumn("_n", F.count("*").over(W.partitionBy(key)))
    fine = F.col("_left").isNotNull() & F.col("_right").isNotNull() & (F.col("_n") == 1)
    checked = F.when(fine, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no single partner for key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return both.withColumn(key, checked.cast(left.schema[key].dataType)).drop("_left", "_right", "_n")


def evict(archived: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` whose content is in the archive under the same hash keep a reference instead of their HTML."""
    kept = archived.select("url", F.col("archive_sha256").alias("_h")).distinct()
    digest = F.sha2(F.col("html").cast("binary"), 256)
    joined = pages.withColumn("_d", digest).join(kept, (pages["url"] == kept["url"]) & (F.col("_d") == F.col("_h")), "left").drop(kept["url"])
    return joined.withColumn("html", F.when(F.col("_h").isNull(), F.col("html"))).withColumn("archive_ref", F.col("_h")).drop("_d", "_h")


def restore_sample(archived: DataFrame, live: DataFrame, per_mille: int = 10) -> DataFrame:
    """``(checked, broken)`` of a hashed sample of archived pages against the live ones."""
    sample = archived.where(F.pmod(F.xxhash64("url"), F.lit(1000)) < per_mille).select("url", "archive_sha256")
    both = sample.join(live.select("url", F.sha2(F.col("html").cast("binary"), 256).alias("d")), "url", "left")
    return both.agg(F.count("*").alias("checked"), F.count_if(~F.coalesce(F.col("d") == F.col("archive_sha256"), F.lit(False))).alias("broken"))


def repair_urls(frontier: DataFrame, rewrite: Column) -> tuple[DataFrame, DataFrame]:
    """``(repaired, report)``: URLs rewritten where the target is free; taken targets make the old row ``excluded``.

    Every row stays one row, however often its target is listed; of rows with the same target the first by URL, then
    state, moves. Rows without a URL are kept. Pure transforms: running them twice changes nothing, and the report alone
    is the dry run.
    """
    moved = frontier.withColumn("_to", rewrite)
    taken = frontier.select(F.col("url").alias("_to"), F.lit(True).alias("_taken")).distinct()
    first = F.row_number().over(W.partitionBy("_to").orderBy("url", "state"))
    marked = moved.join(taken, "_to", "left").withColumn("_k", first)
    change = F.when(F.col("_to").isNull() | (F.col("_to") == F.col("url")), "kept").when(F.col("_taken").isNotNull() | (F.col("_k") > 1), "excluded").otherwise("moved")
    marked = marked.withColumn("_change", change)
    repaired = marked.withColumns({"url": F.when(F.col("_change") == "moved", F.col("_to")).otherwise(F.col("url")), "state": F.when(F.col("_change") == "excluded", "excluded").otherwise(F.col("state"))}).select(*frontier.columns)
    return repaired, marked.groupBy(F.col("_change").alias("change")).agg(F.count("*").alias("n"))


def listing_redirects(fetches: DataFrame, listing: Column) -> DataFrame:
    """URLs whose answer led to a listing page: ``fetches(url, final_url)``; they are excluded from the corpus."""
    return fetches.where((F.col("final_url") != F.col("url")) & listing).select("url").distinct()
