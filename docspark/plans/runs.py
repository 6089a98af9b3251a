"""Queries over runs: limits, stops, health, warnings, statistics to show; sources of URLs, titles and images of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.functions import url as U
from docspark.operators import control, extract, lint, state
from docspark.plans.crawl import _EV, _events, _images, _pages
from docspark.plans.pages import _ENTITIES, BASE, ROOT
from docspark.plans.registry import query, table, texts
from docspark.sources import sitemap, vault


def _domain_of_nodes(mode):
    def run(spark, sf_dir):
        """The restriction of hierarchies, where even without one URLs stay below the root."""
        return table(spark, sf_dir, "pages").where(U.allowed(F.col("url"), mode, ROOT, BASE, True)).select("page_id", "url")

    run.__name__ = f"q_domain_filter_nodes_{mode}"
    return run


query(f"SELECT page_id, url FROM pages WHERE url LIKE '{BASE}%'")(_domain_of_nodes("product"))
query(f"SELECT page_id, url FROM pages WHERE url LIKE '{ROOT}%'")(_domain_of_nodes("off"))


@query("SELECT page_id % 10 AS map, page_id, url FROM pages WHERE page_id % 3 = CASE WHEN page_id % 10 < 5 THEN 1 ELSE 2 END AND strpos(url, '&') = 0")
def q_sitemap_first_source(spark, sf_dir):
    """Ten sites with three candidate sitemaps each; the first has no locations, the second has some for half of the sites."""
    p = table(spark, sf_dir, "pages").where("instr(url, '&') = 0").select("page_id", "url", (F.col("page_id") % 10).alias("map"), (F.col("page_id") % 3).cast("int").alias("rank"))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    maps = p.groupBy("map", "rank").agg(F.array_join(F.collect_list(F.when((F.col("rank") == 2) | ((F.col("rank") == 1) & (F.col("map") < 5)), entry)), "").alias("xml"))
    found = maps.select("map", "rank", F.explode(sitemap.locations(F.col("xml"))).alias("url"))
    best = found.groupBy("map").agg(F.min("rank").alias("rank"))
    # Pages may share a URL: those of the map and sitemap that tell it count, each once.
    return p.join(found.join(best, ["map", "rank"]), ["map", "rank", "url"], "left_semi").select("map", "page_id", "url")


# ---- limits, stops, health ----


@query(f"WITH {_EV} SELECT url, crawl_depth FROM st WHERE crawl_depth <= 2 AND updated_at < (SELECT min(ts) + INTERVAL 60 DAY FROM ev) ORDER BY updated_at, url LIMIT 50")
def q_run_limits(spark, sf_dir):
    """The first 50 pages of a run of 60 days down to depth 2: the page limit is the feature."""
    started = _events(spark, sf_dir).agg(F.min("ts").alias("started"))
    rows = _pages(spark, sf_dir).join(F.broadcast(started), F.lit(True))
    return control.within_limits(rows, "updated_at", F.col("started"), 60 * 24 * 60, 50, 2).select("url", "crawl_depth")


@query("""
WITH g AS (SELECT *, event_type = 'error' AS f, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
r AS (SELECT user_id, event_id, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM g),
s AS (SELECT user_id, min(event_id) AS stop FROM r WHERE run >= 3 GROUP BY user_id)
SELECT e.user_id, e.event_id FROM events e LEFT JOIN s ON s.user_id = e.user_id WHERE stop IS NULL OR e.event_id <= stop
""")
def q_stop_after_failures(spark, sf_dir):
    return control.until_stopped(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", 3).select("user_id", "event_id")


@query("""
WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events WHERE event_type = 'error')
SELECT user_id, event_id, CAST(age AS INT) AS age, age <= 10 AS told FROM w WHERE age <= 100
""")
def q_recent_warnings(spark, sf_dir):
    """The last 100 warnings of each user, of which ten are told: the ring is the feature."""
    return control.recent(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "event_id").select("user_id", "event_id", "age", "told")


_PROBES = """p AS (SELECT event_id, event_id % 7 AS disk_free_gb, event_id % 101 AS disk_used, (event_id % 5) / 2.0 AS memory_free_gb, event_id % 97 AS memory_used, event_id % 100 AS cpu_used FROM events),
c AS (SELECT *, disk_free_gb > 1 AND disk_used < 90 AS disk_ok, memory_free_gb > 0.5 AND memory_used < 85 AS memory_ok, cpu_used < 90 AS cpu_ok, CAST(event_id % 9 + 1 AS INT) AS had FROM p)"""


def _checked(spark, sf_dir):
    n = F.col("event_id")
    probes = table(spark, sf_dir, "events").select("event_id", (n % 7).alias("disk_free_gb"), (n % 101).alias("disk_used"), (n % 5 / 2).alias("memory_free_gb"), (n % 97).alias("memory_used"), (n % 100).alias("cpu_used"))
    return control.health(probes, (n % 9 + 1).cast("int"))


@query(f"WITH {_PROBES} SELECT event_id, disk_ok, memory_ok, cpu_ok, CASE WHEN memory_ok THEN had ELSE greatest(1, CAST(had // 2 AS INT)) END AS workers FROM c")
def q_health_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_id", "disk_ok", "memory_ok", "cpu_ok", "workers")


@query(f"WITH {_PROBES} SELECT count(*) AS probes, bool_and(disk_ok AND memory_ok AND cpu_ok) AS healthy, bool_or(NOT (disk_ok AND memory_ok AND cpu_ok)) AS any_problem, count(*) FILTER (WHERE disk_ok AND memory_ok AND cpu_ok) AS well FROM c")
def q_health_rollup(spark, sf_dir):
    return control.roll_up(_checked(spark, sf_dir))


# ---- what is shown ----


@query(f"""
WITH {_EV}, l AS (SELECT 'pages' AS part, unnest(['total', 'completed', 'failed', 'pending', 'in_progress']) AS name), m AS (SELECT 'images' AS part, unnest(['total', 'downloaded', 'failed']) AS name)
SELECT part, name, (SELECT count(*) FROM st WHERE name = 'total' OR status = name) AS n FROM l
UNION ALL SELECT part, name, (SELECT count(*) FROM labels WHERE name = 'total' OR (name = 'downloaded' AND quality = 1) OR (name = 'failed' AND toxic = 1)) FROM m
""")
def q_statistics_table(spark, sf_dir):
    return state.statistics_table(_pages(spark, sf_dir), _images(spark, sf_dir))


@query(f"WITH {_EV} SELECT url, file_path FROM st WHERE file_path IS NOT NULL")
def q_mapped_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
    return state.mapped(pages).select("url", "file_path")


@query("SELECT DISTINCT 'https://h/' || user_id AS url FROM events ORDER BY url")
def q_discovered_urls(spark, sf_dir):
    return state.discovered_urls(_events(spark, sf_dir))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN 'x  ' ELSE 'x' END AS t FROM documents)
SELECT count(*) AS files, count(*) FILTER (WHERE regexp_matches(t, '[ \t\r\f\x0B](\n|\z)')) AS fixed FROM d
""")
def q_fixed_files(spark, sf_dir):
    """Files whose lines lose blanks at their ends, every other file one at least."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "x  ").otherwise("x"))
    rows = texts(spark, sf_dir, "documents").select(text.alias("t")).withColumn("fixed", F.array_join(F.transform(lint.lines(F.col("t")), lint.without_trailing), "\n"))
    return vault.file_counts(rows, "t", "fixed")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS name FROM events")
def q_stamps(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", X.iso_stamp(at).alias("iso"), X.file_stamp(at).alias("name"))


# ---- pages: titles, links, images, hierarchies ----


@query("SELECT page_id, trim(" + _ENTITIES.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + ") AS title FROM pages")
def q_page_title(spark, sf_dir):
    return extract.titles(texts(spark, sf_dir, "pages")).select("page_id", F.col("page_title").alias("title"))


def _with_main(spark, sf_dir):
    """Pages below one path, with a navigation and a main block of known links and images before their own HTML."""
    n = F.col("page_id").cast("string")
    near = (F.col("page_id") % 7).cast("string")
    known = F.concat(
        F.lit('<nav><li><a href="/docs/a-'), near, F.lit('/">a</a></li></nav><main><p><a href="/docs/b-'), n, F.lit('#x">b</a> <a href="/docs/a-'), near, F.lit('">again</a> <a href="/login">no</a> <img src="/i/'), near,
        F.lit('.png"> <img src="/i/'), n, F.lit('.png"></p></main>'),
    )
    return extract.pages(texts(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h/docs/p-"), n).alias("url"), F.concat(known, F.coalesce("html", F.lit(""))).alias("html")))


@query("SELECT page_id, 'https://h/docs/a-' || (page_id % 7) AS link FROM pages UNION ALL SELECT page_id, 'https://h/docs/b-' || page_id FROM pages")
def q_documentation_links(spark, sf_dir):
    """Links of navigation and main block together, each once."""
    return extract.documentation_links(_with_main(spark, sf_dir), "https://h/docs/")


@query("""
WITH i AS (SELECT DISTINCT page_id, 'https://h/i/' || k || '.png' AS url FROM (SELECT page_id, unnest([page_id, page_id % 7]) AS k FROM pages))
SELECT url, count(*) AS pages FROM i GROUP BY url
""")
def q_distinct_images(spark, sf_dir):
    return extract.image_urls(_with_main(spark, sf_dir))


@query("SELECT page_id, 3 + CAST(page_id % 2 AS BIGINT) AS nodes, 1 + CAST(page_id % 2 AS BIGINT) AS mapped FROM pages")
def q_hierarchy_counts(spark, sf_dir):
    """Navigation, child list and entries together; every other page has a child within the child list."""
    state_of = F.concat(
        F.lit('{"navigation":[{"url":"/n"}],"entry":{"childList":[{"slug":"c","childList":['), F.when(F.col("page_id") % 2 == 1, '{"slug":"d"}').otherwise(""),
        F.lit(']}]},"pages":[{"href":"/p'), F.col("page_id").cast("string"), F.lit('"},{"url":"https://elsewhere/x"}]}'),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", state_of.alias("state"))
    nodes = rows.lateralJoin(sitemap.Hierarchy(F.col("state").outer(), F.lit("https://h/"))).select("page_id", "mapped")
    return extract.hierarchy_counts(nodes, "page_id")
