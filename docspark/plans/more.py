"""Queries over redirects' files, verification, reachability, metadata, images, runs and previews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import diff, registered
from docspark.operators import links, state
from docspark.operators.lineage import shared_folder
from docspark.plans import flows
from docspark.plans.corpus import _VAULT, BASE, _vault
from docspark.plans.crawl import _EV, _events, _images, _pages
from docspark.plans.registry import query, table, texts
from docspark.sources import store


def _url(c):
    return F.concat(F.lit("https://s/"), c.cast("long").cast("string"))


@query("""
SELECT 'https://s/' || page_id AS url, 'https://s/' || (page_id // 10 * 10) AS final, CASE WHEN page_id // 10 % 2 = 0 THEN 'docs/' || (page_id // 10 * 10) || '.md' END AS file_path FROM pages
""")
def q_canonical_file(spark, sf_dir):
    """Each page redirects to the one before it, down to a multiple of ten; every other of these has a file."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id")
    edges = p.where(n % 10 != 0).select(_url(n).alias("src"), _url(n - 1).alias("dst"))
    files = p.where(n % 20 == 0).select(_url(n).alias("url"), F.concat(F.lit("docs/"), n.cast("string"), F.lit(".md")).alias("file_path"))
    return links.canonical_files(p.select(_url(n).alias("url")), edges, files)


@query(f"WITH {_EV} SELECT 'r' || url AS url, url AS final_url FROM st WHERE status = 'completed'")
def q_redirect_done(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return links.already_done(p.select(F.concat(F.lit("r"), "url").alias("url"), F.col("url").alias("final_url")), p)


@query("SELECT 'https://s/' || page_id AS url, CAST(length(bin(page_id)) - 1 AS INT) AS depth FROM pages WHERE page_id >= 1")
def q_bfs_reachable(spark, sf_dir):
    """Until nothing is new: all pages but page 0, to which no link leads."""
    return _bfs(spark, sf_dir, None)


def _bfs(spark, sf_dir, depth):
    """From page 1 over a binary tree of links, with links back to the root."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").where(n > 0).select(n)
    edges = p.where(n > 1).select(_url(F.floor(n / 2)).alias("parent_url"), _url(n).alias("url")).union(p.select(_url(n), _url(F.lit(1))))
    return links.reachable(p.where(n == 1).select(_url(n).alias("url")), edges, depth)


@query(f"""
WITH {_VAULT}, t AS (SELECT DISTINCT 'page-' || (event_id % 400) AS target FROM events)
SELECT target, replace(file_path, '.md', '') AS file FROM t JOIN v ON v.url = '{BASE}/docs/' || target WHERE ord % 2 = 0
""")
def q_verified_links(spark, sf_dir):
    """Every other docs page was found alive, at the URL without a slash."""
    v = _vault(spark, sf_dir)
    checks = v.where("ord % 2 = 0 and url like '%/docs/%'").select("url", F.concat("url", F.lit("/")).alias("final_url"))
    targets = table(spark, sf_dir, "events").select(F.concat(F.lit("page-"), (F.col("event_id") % 400).cast("string")).alias("target"))
    return links.verified(targets, checks, v, BASE)


@query(f"WITH {_VAULT} SELECT ord, CASE WHEN ord % 3 = 0 THEN 'N' || ord ELSE '' END AS title, '' AS description FROM v")
def q_hierarchy_metadata(spark, sf_dir):
    v = _vault(spark, sf_dir)
    nodes = v.where("ord % 3 = 0").select(F.concat("url", F.lit("/")).alias("url"), F.concat(F.lit("N"), F.col("ord").cast("string")).alias("title"), F.lit("").alias("description"), F.col("ord").alias("ordinal"))
    return links.with_metadata(v.drop("title"), nodes).select("ord", "title", "description")


def _fold_sql(where: str) -> str:
    return f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_id AS seq, event_type = 'click' AS downloaded, CASE WHEN event_type = 'error' THEN props END AS error FROM events{where})
SELECT CAST(doc_id AS VARCHAR) AS url, coalesce(x.downloaded, quality = 1) AS downloaded, CASE WHEN x.url IS NOT NULL THEN x.error WHEN toxic = 1 THEN 'bad' END AS error_message
FROM labels LEFT JOIN (SELECT url, arg_max(downloaded, seq) AS downloaded, arg_max(coalesce(error, ''), seq) AS e0, CASE WHEN arg_max(coalesce(error, ''), seq) = '' THEN NULL ELSE arg_max(coalesce(error, ''), seq) END AS error FROM e GROUP BY url) x ON x.url = CAST(doc_id AS VARCHAR)
"""


def _fold(spark, sf_dir, events):
    images = _images(spark, sf_dir).withColumns({"page_url": F.lit("p"), "local_path": F.lit(None).cast("string")})
    kind = F.col("event_type")
    events = events.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("local_path"), (kind == "click").alias("downloaded"), F.when(kind == "error", F.col("props")).alias("error_message"))
    return state.fold_images(images, events).select("url", "downloaded", "error_message")


@query(_fold_sql(""))
def q_images_fold(spark, sf_dir):
    """The events of all users."""
    return _fold(spark, sf_dir, table(spark, sf_dir, "events"))


@query("SELECT CAST(doc_id AS VARCHAR) AS url FROM labels WHERE doc_id % 200 NOT IN (SELECT user_id FROM events)")
def q_image_orphans(spark, sf_dir):
    images = _images(spark, sf_dir).withColumn("page_url", F.concat(F.lit("https://h/"), (F.col("url").cast("long") % 200).cast("string")))
    return state.orphans(images, _pages(spark, sf_dir)).select("url")


@query("""SELECT CAST(id AS BIGINT) AS id, CASE WHEN id = 2 THEN (SELECT count(DISTINCT user_id) FROM events) END AS pages_total, id = 2 AS ended FROM (VALUES (1), (2)) t(id)""")
def q_finished_run(spark, sf_dir):
    runs = schemas.grown(spark.createDataFrame([(1,), (2,)], "id long"), schemas.RUNS)
    done = state.finished_run(runs, 2, state.run_statistics(_pages(spark, sf_dir), _images(spark, sf_dir)), F.current_timestamp())
    return done.select("id", "pages_total", F.col("completed_at").isNotNull().alias("ended"))


@query("SELECT page_id, url, 'pending' AS status, CAST(0 AS INT) AS retry_count FROM pages")
def q_schema_growth(spark, sf_dir):
    """An older table without most columns takes the present form."""
    old = table(spark, sf_dir, "pages").select("page_id", "url")
    return schemas.grown(old, f"page_id bigint, {schemas.PAGES}").select("page_id", "url", "status", "retry_count")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]', ' ', 'g') || '.' AS t FROM documents),
l AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)
SELECT doc_id, '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -' || len(l) || ' +' || len(l) || ',2 @@' || chr(10) || ' ' || l[-1] || chr(10) || '+' || doc_id AS preview FROM l
""")
def q_diff_preview(spark, sf_dir):
    """Whole texts against themselves with one line more; line ends of other kinds count as blanks."""
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]", " "), F.lit("."))
    return texts(spark, sf_dir, "documents").select("doc_id", diff.preview(text, F.concat(text, F.lit("\n"), F.col("doc_id").cast("string"))).alias("preview"))


@query("""SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host, 'a-b' AS tag, least(pow(2.0, page_id % 5), 10.0) AS wait FROM pages""")
def q_sql_functions(spark, sf_dir):
    registered.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("_pages_for_functions")
    return spark.sql("SELECT page_id, url_host(url) AS host, normalize_tag(' A & B ') AS tag, backoff_seconds(CAST(page_id % 5 + 1 AS INT), 10.0D) AS wait FROM _pages_for_functions")


# ---- state tables that last ----


def _store(spark, name):
    root = shared_folder(spark)
    return store.Store(spark, f"{root}/store-{name}-{uuid.uuid4().hex}")


def _kept_pages(spark, sf_dir, name):
    """Pages are inserted, change by the events of even and odd ids in turn, and get titles; each change is a snapshot of its own."""
    s = _store(spark, name)
    events = _events(spark, sf_dir)
    first = events.groupBy("url").agg(F.min("ts").alias("created_at"), F.min("seq").alias("ord"))
    s.insert_new("pages", first, "ord")
    s.insert_new("pages", first.limit(10), "ord")
    s.fold_pages(events.where("seq % 2 = 0"))
    s.fold_pages(events.where("seq % 2 = 1"))
    n = F.substring_index("url", "/", -1)
    s.set_titles(first.where(n.cast("long") % 3 == 0).select("url", F.concat(F.lit("T"), n).alias("title")).union(spark.createDataFrame([("nowhere", "x"), ("https://h/1", "")], "url string, title string")))
    return s


@query(f"""
WITH {_EV}, odd AS (SELECT url, arg_max(status, seq) AS s FROM ev WHERE seq % 2 = 1 GROUP BY url), even AS (SELECT url, arg_max(status, seq) AS s FROM ev WHERE seq % 2 = 0 GROUP BY url)
SELECT st.url, coalesce(odd.s, even.s) AS status, st.retry_count, CASE WHEN CAST(split_part(st.url, '/', 4) AS BIGINT) % 3 = 0 THEN 'T' || split_part(st.url, '/', 4) END AS title
FROM st LEFT JOIN odd ON odd.url = st.url LEFT JOIN even ON even.url = st.url
""")
def q_store_pages(spark, sf_dir):
    return _kept_pages(spark, sf_dir, "pages").read("pages").select("url", "status", "retry_count", "title")


@query("SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 4 = 0 THEN true ELSE quality = 1 END AS downloaded, CASE WHEN doc_id % 4 = 0 THEN 'images/' || doc_id || '.png' END AS local_path FROM labels")
def q_store_images(spark, sf_dir):
    """Images are put in, then those of every fourth are put in again with their file."""
    s = _store(spark, "images")
    images = _images(spark, sf_dir)
    s.upsert("images", images)
    s.upsert("images", images.where(F.col("url").cast("long") % 4 == 0).select("url", F.lit(True).alias("downloaded"), F.concat(F.lit("images/"), "url", F.lit(".png")).alias("local_path")))
    return s.read("images").select("url", "downloaded", "local_path")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), true, (SELECT count(DISTINCT user_id) FROM events)), (2, false, NULL)) t(id, ended, pages_total)")
def q_store_runs(spark, sf_dir):
    """A run that ends and one that goes on."""
    s = _kept_pages(spark, sf_dir, "runs")
    s.finish_run(s.start_run(F.current_timestamp()), F.current_timestamp())
    s.start_run(F.current_timestamp())
    return s.read("runs").where(F.col("started_at").isNotNull()).select("id", F.col("completed_at").isNotNull().alias("ended"), "pages_total")


@query("SELECT (SELECT count(DISTINCT user_id) FROM events) AS before, 1 AS found, CAST(0 AS BIGINT) AS after, true AS any_before, false AS any_after")
def q_store_clear(spark, sf_dir):
    """Rows before and after all tables are emptied, a look-up of one page, and the probes for any row."""
    s = _kept_pages(spark, sf_dir, "clear")
    before, found, any_before = s.read("pages").count(), s.find("pages", s.read("pages").first().url).count(), s.has_any("pages")
    s.clear()
    return spark.createDataFrame([(before, found, s.read("pages").count(), any_before, s.has_any("pages"))], "before long, found int, after long, any_before boolean, any_after boolean")


# ---- flows of images and retries ----


@query("""
WITH d AS (SELECT doc_id, doc_id % 50 AS k, coalesce(text, '') AS t FROM documents), p AS (SELECT k, min('p' || doc_id) AS folder FROM d GROUP BY k)
SELECT doc_id, t || CASE WHEN d.k < 40 THEN ' ![[images/' || folder || '/' || d.k || '.png]]' ELSE ' ![x](https://i/' || d.k || '.png)' END AS text FROM d JOIN p ON p.k = d.k
""")
def q_flow_images(spark, sf_dir):
    """Of 50 images 40 come, five are empty, five nobody fetched."""
    docs, found, stored = _image_inputs(spark, sf_dir)
    return flows.image_flow(docs, found, stored)[1].select("doc_id", "text")


@query("SELECT 'https://i/' || (doc_id % 50) || '.png' AS url, doc_id % 50 < 40 AS downloaded, CASE WHEN doc_id % 50 BETWEEN 40 AND 44 THEN 'empty image' END AS error_message FROM documents GROUP BY doc_id % 50")
def q_flow_image_states(spark, sf_dir):
    docs, found, stored = _image_inputs(spark, sf_dir)
    return flows.image_flow(docs, found, stored)[0].select("url", "downloaded", "error_message")


def _image_inputs(spark, sf_dir):
    url = lambda k: F.concat(F.lit("https://i/"), k.cast("string"), F.lit(".png"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", url(F.col("doc_id") % 50).alias("u"))
    docs = d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" ![x]("), "u", F.lit(")")).alias("text"))
    found = d.select(F.concat(F.lit("https://h/p"), F.col("doc_id").cast("string")).alias("page_url"), F.col("u").alias("url"))
    content = F.when(F.col("id") < 40, F.unhex(F.lit("89504E470D0A1A0A0000000D"))).otherwise(F.unhex(F.lit("")))
    return docs, found, spark.range(45).select(url(F.col("id")).alias("url"), content.alias("content"), F.lit(None).cast("string").alias("content_type"))


@query(f"""
WITH {_EV}, f AS (SELECT *, CAST(split_part(url, '/', 4) AS BIGINT) % 4 AS u, least(5, 22 - retry_count) AS tries FROM st), w AS (SELECT *, CASE WHEN u = 0 THEN 4 ELSE 4 - u END AS w, status = 'failed' AND retry_count < 22 AS retried FROM f)
SELECT url, CASE WHEN NOT retried THEN status WHEN w <= tries THEN 'completed' ELSE 'failed' END AS status, CAST(retry_count + CASE WHEN NOT retried THEN 0 WHEN w <= tries THEN w - 1 ELSE tries END AS INT) AS retry_count,
  CASE WHEN NOT retried THEN 0.0 ELSE list_sum(list_transform(range(1, least(w, tries) + 1), lambda k: least(30.0, pow(2.0, k - 1)))) END AS waited FROM w
""")
def q_flow_retry(spark, sf_dir):
    """Failed pages are tried up to five times; the first success depends on the page."""
    pages = _pages(spark, sf_dir)
    user = F.substring_index("url", "/", -1).cast("long")
    outcomes = pages.select("url", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt")).select("url", "attempt", ((user + F.col("attempt")) % 4 == 0).alias("ok"), F.lit("e").alias("error"))
    return flows.retry_flow(pages, outcomes, 22).select("url", "status", "retry_count", "waited")
