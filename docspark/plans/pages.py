"""Queries over pages: URLs, file places, HTML, sitemaps and embedded state."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import image as I
from docspark.functions import path as P
from docspark.functions import text as X
from docspark.functions import url as U
from docspark.operators import extract
from docspark.plans.registry import query, table, texts
from docspark.sources import sitemap, vault

ROOT, BASE = "https://", "https://m."

HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
PATH = "regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
SEGMENT = f"list_extract(string_split(regexp_replace({PATH}, '/+$', ''), '/'), -1)"
BARE = r"regexp_replace(html, '(?is)<script\b.*?</script>|<!--.*?-->', '', 'g')"
LOWER_WORDS = ", ".join(f"'{w}'" for w in P.LOWER_WORDS)


def _absolute_sql(href: str) -> str:
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} LIKE '//%' THEN regexp_extract(url, '^([A-Za-z]+):', 1) || ':' || {href}
      WHEN {href} LIKE '/%' THEN {ORIGIN} || {href} WHEN {href} LIKE '#%' THEN regexp_replace(url, '#.*$', '') || {href} ELSE {ORIGIN} || regexp_replace({PATH}, '[^/]*$', '') || {href} END"""


def _title_sql(slug: str) -> str:
    word = f"CASE WHEN w = '' THEN '' WHEN lower(w) IN ({LOWER_WORDS}) AND i > 1 THEN lower(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END"
    return f"array_to_string(list_filter(list_transform(string_split({slug}, '-'), lambda w, i: {word}), lambda w: w <> ''), ' ')"


def _clean_sql(text: str) -> str:
    name = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '[<>:"|?*]', '', 'g'), '[/\\\\]', '-', 'g'), '\\s+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g')"""
    return f"CASE WHEN length({name}) > 100 THEN left({name}, 97) || '...' ELSE {name} END"


_NORMAL = rf"""{ORIGIN} || CASE WHEN {PATH} = '/' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END ||
  CASE WHEN len(list_filter(string_split({QUERY}, '&'), lambda p: p LIKE '%=%' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'ref'))) > 0
  THEN '?' || array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: p LIKE '%=%' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'ref')), '&') ELSE '' END"""


@query(f"""
WITH links AS (SELECT page_id, url, unnest(regexp_extract_all({BARE}, 'href="([^"]*)"', 1)) AS href FROM pages),
full_links AS (SELECT page_id, {_absolute_sql('href')} AS url FROM links)
SELECT {HOST} AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM full_links WHERE url LIKE '{ROOT}%' GROUP BY 1
""")
def q_page_links_by_host(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(X.hrefs(F.col("html"))).alias("href"))
    full = links.select("page_id", U.absolute(F.col("url"), F.col("href")).alias("url")).where(U.allowed(F.col("url"), "any", ROOT, BASE))
    return full.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query(f"SELECT page_id, {_NORMAL} AS normal FROM pages")
def q_url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normal"))


@query(rf"""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, {HOST} AS host, {PATH} AS path, {QUERY} AS query, regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment FROM pages""")
def q_url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.scheme(url).alias("scheme"), U.host(url).alias("host"), U.path(url).alias("path"), U.query(url).alias("query"), U.fragment(url).alias("fragment"))


@query(f"SELECT split_part(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/', 1) AS product, count(*) AS n FROM pages GROUP BY 1")
def q_product(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.product(F.col("url")).alias("product")).agg(F.count("*").alias("n"))


@query("""
WITH u AS (SELECT page_id, lower(url || '-' || list_extract(['get-started', 'Install', 'basics', 'tutorial', 'x'], CAST(page_id % 5 + 1 AS INT))) AS url FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, 'get-started|overview|what-is|introduction') THEN 1 WHEN regexp_matches(url, 'setup|install|configure|sign-up') THEN 2
  WHEN regexp_matches(url, 'features|basics|fundamentals') THEN 3 WHEN regexp_matches(url, 'how-to|guide|tutorial') THEN 4 ELSE 5 END AS priority FROM u
""")
def q_url_priority(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("get-started", "Install", "basics", "tutorial", "x"))), (F.col("page_id") % 5 + 1).cast("int"))
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("-"), word).alias("url"))
    return sitemap.prioritised(urls).select("page_id", "priority")


def _domain(mode):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "pages").where(U.allowed(F.col("url"), mode, ROOT, BASE)).select("page_id", "url")

    run.__name__ = f"q_domain_filter_{mode}"
    return run


query(f"SELECT page_id, url FROM pages WHERE url LIKE '{BASE}%'")(_domain("product"))
query(f"SELECT page_id, url FROM pages WHERE url LIKE '{ROOT}%'")(_domain("any"))
query("SELECT page_id, url FROM pages")(_domain("off"))


@query(f"""
WITH u AS (SELECT page_id, {ORIGIN} || '/' || list_extract(['docs/a', 'resources/b', 'x'], CAST(page_id % 3 + 1 AS INT)) AS url FROM pages)
SELECT page_id, url FROM u WHERE url LIKE '{BASE}%' AND (url LIKE '%/docs/%' OR url LIKE '%/resources/%')
""")
def q_sitemap_filter(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("docs/a", "resources/b", "x"))), (F.col("page_id") % 3 + 1).cast("int"))
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(U.origin(F.col("url")), F.lit("/"), kind).alias("url"))
    return urls.where(U.sitemap_wanted(F.col("url"), "product", ROOT, BASE))


@query("SELECT count(*) AS urls, count(*) FILTER (WHERE page_id % 3 = 0) AS docs, count(*) FILTER (WHERE page_id % 3 = 1) AS resources FROM pages")
def q_sitemap_kinds(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("/docs/", "/resources/", "/x/"))), (F.col("page_id") % 3 + 1).cast("int"))
    return sitemap.kind_counts(table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract("url", "^[a-z]+://", 0), F.lit("h"), kind, F.col("page_id").cast("string")).alias("url")))


@query(f"""
WITH u AS (SELECT page_id, {ORIGIN} || '/en/' || list_extract(['page', 'API/v1', 'file.PDF', 'login', 'x/download/y'], CAST(page_id % 5 + 1 AS INT)) AS url FROM pages)
SELECT page_id, url FROM u WHERE regexp_extract(url, '^[a-z]+://([^/]*)', 1) = 'tionsh.example.net' AND {PATH} LIKE '/en%'
  AND NOT regexp_matches({PATH}, '(?i)/api/|/rest/|\\.pdf$|\\.zip$|/download/|/attachments/|/login|/signup')
""")
def q_valid_doc_url(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("page", "API/v1", "file.PDF", "login", "x/download/y"))), (F.col("page_id") % 5 + 1).cast("int"))
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(U.origin(F.col("url")), F.lit("/en/"), kind).alias("url"))
    return urls.where(U.is_documentation(F.col("url"), "https://tionsh.example.net/en/"))


@query(f"WITH n AS (SELECT page_id, {_NORMAL} AS normal FROM pages) SELECT normal, min(page_id) AS page_id, count(*) AS n FROM n GROUP BY normal")
def q_url_dedup_normalized(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normal"))
    return rows.groupBy("normal").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


_SLUG = f"regexp_replace(lower(p_name || ' of the ' || p_brand), '[^a-z0-9]+', '-', 'g')"


@query(f"SELECT p_partkey, {_title_sql(_SLUG)} AS title FROM part")
def q_slug_title(spark, sf_dir):
    slug = F.regexp_replace(F.lower(F.concat("p_name", F.lit(" of the "), "p_brand")), "[^a-z0-9]+", "-")
    return table(spark, sf_dir, "part").select("p_partkey", P.slug_title(slug).alias("title"))


@query(f"WITH d AS (SELECT doc_id, '..' || regexp_replace(coalesce(text, ''), '[\\x80-\\x{{10FFFF}}]', 'x', 'g') || ' a/b:c?.' AS t FROM documents) SELECT doc_id, {_clean_sql('t')} AS name FROM d")
def q_clean_name(spark, sf_dir):
    t = F.concat(F.lit(".."), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x{80}-\x{10FFFF}]", "x"), F.lit(" a/b:c?."))
    return table(spark, sf_dir, "documents").select("doc_id", P.safe_name(t).alias("name"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM documents")
def q_tag_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.tag(F.coalesce("text", F.lit(""))).alias("tag"))


_FROM = "'docs/' || (page_id % 3) || '/' || CASE WHEN page_id % 2 = 0 THEN 'deep/er/' ELSE '' END || 'p.md'"
_TO = "'docs/' || (page_id % 2) || '/' || CASE WHEN page_id % 5 = 0 THEN 'deep/' ELSE '' END || 'q' || page_id || '.md'"


@query(f"""
WITH p AS (SELECT page_id, string_split(replace({_FROM}, '.md', ''), '/') AS a, string_split(replace({_TO}, '.md', ''), '/') AS b FROM pages),
c AS (SELECT *, len(list_filter(range(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])) AS common FROM p)
SELECT page_id, repeat('../', CAST(len(a) - 1 - common AS INT)) || array_to_string(b[common + 1:], '/') AS link FROM c
""")
def q_relative_path(spark, sf_dir):
    n = F.col("page_id")
    a = F.concat(F.lit("docs/"), (n % 3).cast("string"), F.lit("/"), F.when(n % 2 == 0, "deep/er/").otherwise(""), F.lit("p.md"))
    b = F.concat(F.lit("docs/"), (n % 2).cast("string"), F.lit("/"), F.when(n % 5 == 0, "deep/").otherwise(""), F.lit("q"), n.cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "pages").select("page_id", P.relative(a, b).alias("link"))


@query(f"""
WITH u AS (SELECT page_id, {ORIGIN} || '/docs/' || regexp_replace(lower({SEGMENT}), '[^a-z0-9-]', '', 'g') || '-the-page' || CASE WHEN page_id % 4 = 0 THEN '/' ELSE '' END AS url, page_id % 3 AS k FROM pages)
SELECT page_id, CASE WHEN k = 0 THEN 'docs' WHEN k = 1 THEN 'docs/Set up' ELSE 'docs/Set up/Users' END AS folder,
  CASE WHEN k = 2 THEN 'index.md' WHEN k = 1 THEN 'Title ' || page_id || '.md' WHEN page_id % 4 = 0 THEN 'index.md' ELSE {_title_sql(SEGMENT)} || '.md' END AS name FROM u
""")
def q_url_to_filepath(spark, sf_dir):
    n, k = F.col("page_id"), F.col("page_id") % 3
    slug = F.regexp_replace(F.lower(P.last_segment(F.col("url"))), "[^a-z0-9-]", "")
    url = F.concat(U.origin(F.col("url")), F.lit("/docs/"), slug, F.lit("-the-page"), F.when(n % 4 == 0, "/").otherwise(""))
    crumbs = F.when(k >= 1, F.array(*map(F.lit, ("Support", "Product", "Docs", "Set up", "This page"))))
    place = P.file_place(F.col("u"), F.col("crumbs"), F.col("section"), F.col("title"), F.col("k") == 2)
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("u"), crumbs.alias("crumbs"), F.when(k == 1, "Set up").when(k == 2, "Users").alias("section"), F.when(k == 1, F.concat(F.lit("Title "), n.cast("string"))).alias("title"), k.alias("k"))
    return rows.select("page_id", place.alias("p")).select("page_id", "p.folder", "p.name")


@query(f"""
WITH i AS (SELECT page_id, regexp_replace({PATH}, '^/+|/+$', '', 'g') AS page, list_extract(['a%20b.png', 'photo', ''], CAST(page_id % 3 + 1 AS INT)) AS f, {ORIGIN} || '/img/' AS o FROM pages)
SELECT page_id, replace(page, '/', '_') || '/' || CASE f WHEN 'a%20b.png' THEN 'a b.png' WHEN 'photo' THEN 'photo.jpg' ELSE 'image_' || left(md5(o), 8) || '.jpg' END AS place FROM i
""")
def q_image_local_path(spark, sf_dir):
    file = F.element_at(F.array(*map(F.lit, ("a%20b.png", "photo", ""))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", P.image_place(F.concat(U.origin(F.col("url")), F.lit("/img/"), file), F.col("url")).alias("place"))


@query("""
SELECT event_id, list_extract(['.svg', '.png', '.jpg', '.gif', '.webp', NULL, '.png'], CAST(event_id % 7 + 1 AS INT)) AS extension,
  list_extract([NULL, 'image too large', 'empty image', 'unsupported scheme'], CAST(event_id % 4 + 1 AS INT)) AS refusal FROM events
""")
def q_image_rules(spark, sf_dir):
    k = (F.col("event_id") % 7 + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("image/svg+xml", "", "", "", "", "", "image/PNG"))), k)
    head = F.element_at(F.array(*map(F.lit, ("00", "89504E470D0A1A0A00000000", "FFD8FFE00000000000000000", "474946383961000000000000", "524946460000000057454250", "89504E470D0A1A0A", "00"))), k)
    j = (F.col("event_id") % 4 + 1).cast("int")
    scheme = F.element_at(F.array(*map(F.lit, ("https", "http", "https", "ftp"))), j)
    size = F.element_at(F.array(*(F.lit(x).cast("long") for x in (1000, I.MOST_BYTES + 1, 0, 10))), j)
    return table(spark, sf_dir, "events").select("event_id", I.extension(F.unhex(head), kind).alias("extension"), I.refusal(scheme, size).alias("refusal"))


@query("""
WITH p AS (SELECT page_id, 'docs/' || repeat('x', CAST(page_id % 300 AS INT)) || '.md' AS path, url FROM pages)
SELECT page_id, CASE WHEN length(path) > 250 THEN 'docs/' || repeat('x', 100) || '_' || left(md5(url), 8) || '.md' ELSE path END AS path FROM p
""")
def q_long_path(spark, sf_dir):
    path = F.concat(F.lit("docs/"), F.repeat(F.lit("x"), (F.col("page_id") % 300).cast("int")), F.lit(".md"))
    return table(spark, sf_dir, "pages").select("page_id", P.short_path(path, F.col("url")).alias("path"))


# ---- HTML ----

_ENTITIES = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


@query("SELECT page_id, trim(" + _ENTITIES.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + ") AS title FROM pages")
def q_title(spark, sf_dir):
    return extract.titles(texts(spark, sf_dir, "pages")).select("page_id", "title")


@query(f"""
WITH l AS (SELECT page_id, url, generate_subscripts(h, 1) AS i, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1) AS h FROM pages))
SELECT page_id, count(DISTINCT {_absolute_sql(_ENTITIES.format('href'))}) AS n FROM l GROUP BY page_id
""")
def q_nav_links(spark, sf_dir):
    rows = extract.pages(texts(spark, sf_dir, "pages")).select("page_id", F.explode("navigation").alias("link"))
    return rows.groupBy("page_id").agg(F.countDistinct("link").alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS plain FROM pages""")
def q_text_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain(F.col("html")).alias("plain"))


@query()
def q_html_to_markdown(spark, sf_dir):
    return extract.pages(texts(spark, sf_dir, "pages")).select("page_id", "markdown")


@query()
def q_clean_content(spark, sf_dir):
    return extract.pages(texts(spark, sf_dir, "pages")).select("page_id", "content_text", "images", "emphasis", F.size("links").alias("n_links"))


@query("SELECT page_id, length(html) >= 1000 AS fits FROM pages")
def q_page_size_gate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.large_enough(F.col("html")).alias("fits"))


# ---- sitemaps and state ----


@query("SELECT page_id % 10 AS map, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1")
def q_sitemap_parse(spark, sf_dir):
    """Ten sitemaps made of all pages, parsed again."""
    safe = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url><loc>"), safe, F.lit("</loc><lastmod>2024</lastmod></url>"))
    maps = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 10).alias("map")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda s: s["e"]), "").alias("e"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("e"), F.lit("</urlset>"))
    found = maps.select("map", xml.alias("xml")).where(sitemap.is_xml(F.col("xml"))).select("map", F.explode(sitemap.entries(F.col("xml"))).alias("url"))
    # Pages may share a URL, within a map and over maps: one row for each map and URL, so that a location is counted once.
    own = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 10).alias("map"), "url").agg(F.min("page_id").alias("first"))
    return found.join(own, ["map", "url"]).groupBy("map").agg(F.count("*").alias("n"), F.min("first").alias("first"))


def _state():
    number = F.col("page_id").cast("string")
    head, middle = '<script>window.__STATE__ = /* made */ {"entry":{"topicTitle":"T', '","childList":[{"id":"a","slug":"docs/a'
    tail = '","title":"A","childList":[{"id":"b","slug":"docs/b","title":"B"},{"id":"c","title":"C"}]}]}};</script>'
    return F.concat(F.lit(head), number, F.lit(middle), number, F.lit(tail))


@query("SELECT page_id, 'T' || page_id AS title, page_id % 2 = 1 AS strict_fails FROM pages")
def q_initial_state(spark, sf_dir):
    """State with a comment before it: read by the tolerant form, and by the strict one only where there is no comment."""
    html = F.when(F.col("page_id") % 2 == 0, F.replace(_state(), F.lit("/* made */ "), F.lit(""))).otherwise(_state())
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("h"))
    return rows.select("page_id", extract.topic_titles(X.initial_state(F.col("h"), "__STATE__")).alias("title"), X.initial_state(F.col("h"), "__STATE__", False).isNull().alias("strict_fails"))


@query("""
SELECT page_id, 'https://s/docs/a' || page_id AS url, 'A' AS title, CAST(NULL AS VARCHAR) AS parent, 0 AS depth FROM pages
UNION ALL SELECT page_id, 'https://s/docs/b', 'B', 'https://s/docs/a' || page_id, 1 FROM pages
""")
def q_hierarchy(spark, sf_dir):
    state = X.initial_state(_state(), "__STATE__")
    rows = table(spark, sf_dir, "pages").select("page_id", state.alias("state"))
    return rows.lateralJoin(sitemap.Hierarchy(F.col("state").outer(), F.lit("https://s"))).select("page_id", "url", "title", "parent", "depth")


@query("SELECT page_id, 'Home > Product > P' || page_id AS trail, 3 AS n FROM pages")
def q_breadcrumbs(spark, sf_dir):
    item = lambda n, name: F.concat(F.lit(f'{{"position":{n},"item":{{"name":"'), name, F.lit('","@id":"https://s/"}}'))
    data = F.concat(F.lit('{"@type":"BreadcrumbList","itemListElement":['), item(3, F.concat(F.lit("P"), F.col("page_id").cast("string"))), F.lit(","), item(1, F.lit("Home")), F.lit(',{"position":9},'), item(2, F.lit("Product")), F.lit("]}"))
    rows = table(spark, sf_dir, "pages").select("page_id", sitemap.breadcrumbs(data).alias("b"))
    return rows.select("page_id", F.array_join(F.col("b.name"), " > ").alias("trail"), F.size("b").alias("n"))


@query(f"""
SELECT page_id, '---' || chr(10) || 'url: ''' || url || '''' || chr(10) || 'title: Page ' || page_id || chr(10) || 'tags:' || chr(10) || '- a' || chr(10) || '- p' || (page_id % 3) || chr(10) || '---' AS front FROM pages
""")
def q_frontmatter(spark, sf_dir):
    n = F.col("page_id")
    front = vault.frontmatter([("url", F.col("url")), ("title", F.concat(F.lit("Page "), n.cast("string"))), ("description", F.lit(""))], [("tags", F.array(F.lit("a"), F.concat(F.lit("p"), (n % 3).cast("string"))))])
    return table(spark, sf_dir, "pages").select("page_id", front.alias("front"))

