"""Queries over documents and pages: tags, frontmatter, links, lint, index."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import tags as G
from docspark.functions import text as X
from docspark.operators import index, links, lint, tagging
from docspark.plans.pages import _title_sql
from docspark.plans.registry import query, table, texts

# ---- tags ----

_ASCII_WORDS = r"regexp_extract_all(text, '\b[a-zA-Z][a-zA-Z0-9_-]+\b')"
_STOP = ", ".join(f"'{w}'" for w in G.STOP_WORDS)


def _category_sql(text: str) -> str:
    parts = ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{k}' END" for k, words in G.CATEGORIES.items())
    return f"list_filter([{parts}], lambda c: c IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_category_sql('lower(text)')}, ',') AS categories FROM documents")
def q_category_tags(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.array_join(G.categories(F.col("text")), ",").alias("categories"))


_TECHNICAL = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{k}' END" for k, p in G.TECHNICAL.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{_TECHNICAL}], lambda c: c IS NOT NULL), ',') AS found FROM documents")
def q_technical_patterns(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.array_join(G.technical(F.col("text")), ",").alias("found"))


# Words of ASCII letters only: word borders next to other letters differ between engines.
_PURE = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F]+', '0', 'g')"
_TERMS = rf"""
w AS (SELECT doc_id, list_transform(regexp_extract_all({_PURE}, '\b[a-zA-Z][a-zA-Z0-9_-]+\b'), lambda w: lower(w)) AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_filter(ws, lambda w: length(w) > 3 AND w NOT IN ({_STOP}))) AS term, generate_subscripts(list_filter(ws, lambda w: length(w) > 3 AND w NOT IN ({_STOP})), 1) AS pos FROM w),
c AS (SELECT doc_id, term, count(*) AS n, CAST(min(pos) - 1 AS INT) AS first FROM t GROUP BY doc_id, term)"""


def _ascii(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", "source", "text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]+", "0").alias("ascii"))


@query(f"WITH {_TERMS} SELECT * FROM c")
def q_term_freq(spark, sf_dir):
    return tagging.term_counts(_ascii(spark, sf_dir).select("doc_id", F.col("ascii").alias("text")), "doc_id")


_TAG = "regexp_replace(regexp_replace(term, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_OWN = f"h AS (SELECT doc_id, list_concat(list_distinct([source]), ({_category_sql("lower(coalesce(text, ''))")})[1:2]) AS own FROM documents)"
_TOP = f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k, {_TAG} AS tag FROM c),
g AS (SELECT r.doc_id, tag, row_number() OVER (PARTITION BY r.doc_id ORDER BY k) AS rank FROM r JOIN h ON h.doc_id = r.doc_id WHERE k <= 5 AND n >= 3 AND NOT list_contains(own, tag))"""


def _tagged(spark, sf_dir):
    """own: product and categories; top: the document's own terms that are none of these."""
    rows = _ascii(spark, sf_dir)
    own = G.hierarchical(F.col("source"), F.coalesce("text", F.lit("")), F.lit(""), F.lit(None).cast("array<string>"))
    rows = rows.select("doc_id", own.alias("own"), tagging.counted(G.terms(F.col("ascii"))).alias("counts"))
    return rows.select("doc_id", "own", tagging.top_terms(F.col("counts"), F.col("own")).alias("top"))


@query(f"WITH {_TERMS}, {_OWN}, {_TOP} SELECT doc_id, CAST(rank AS INT) AS rank, tag FROM g WHERE rank <= 2")
def q_top_terms(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", F.posexplode("top").alias("i", "tag")).select("doc_id", (F.col("i") + 1).alias("rank"), "tag")


@query(f"""
WITH {_TERMS}, {_OWN}, {_TOP}, f AS (SELECT doc_id, list(tag ORDER BY rank) AS found FROM g WHERE rank <= 2 GROUP BY doc_id)
SELECT h.doc_id, array_to_string(list_concat(own, CASE WHEN len(found) = 2 AND found[1] = found[2] THEN found[1:1] ELSE coalesce(found, []) END)[1:10], ',') AS tags FROM h LEFT JOIN f ON f.doc_id = h.doc_id
""")
def q_tags_final(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", F.array_join(G.final(F.col("own"), F.col("top")), ",").alias("tags"))


@query("""SELECT doc_id, '---' || chr(10) || 'tags:' || chr(10) || '- a' || chr(10) || chr(10) || '- b' || chr(10) || '---' || chr(10) || coalesce(text, '') || chr(10) || 'k:' || chr(10) || chr(10) || '- x' AS fixed FROM documents""")
def q_yaml_fix(spark, sf_dir):
    text = F.concat(F.lit("---\ntags:\n\n- a\n\n- b\n---\n"), F.coalesce("text", F.lit("")), F.lit("\nk:\n\n- x"))
    return texts(spark, sf_dir, "documents").select("doc_id", X.fix_frontmatter(text).alias("fixed"))


# The steps one after the other; step 2 leaves no heading right behind another, so that step 3 may take the next character along.
_CLEAN = "coalesce(text, '') || chr(10) || 'a  ' || repeat(chr(10), 4) || '- b' || chr(10) || '3. c' || chr(10) || '7. d' || chr(10) || chr(10)"
for _pattern, _new in ((r"\n{3,}", r"\n\n"), (r"\n(#{1,6} )", r"\n\n\1"), (r"(#{1,6} [^\n]+)\n([^\n]|\z)", r"\1\n\n\2"), (r"\n(- )", r"\n\n\1"), (r"\n\d+\. ", r"\n\n1. "), (r"(?m)[ \t]+$", ""), (r"^\s+|\s+$", "")):
    _put = "'" + _new.replace(r"\n", "' || chr(10) || '") + "'"
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', {_put}, 'g')"


@query(f"SELECT doc_id, {_CLEAN} AS fixed FROM documents")
def q_clean_markdown(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\na  \n\n\n\n- b\n3. c\n7. d\n\n"))
    return texts(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(text).alias("fixed"))


# ---- links ----

BASE = "https://s/p"
_NAME = "'page-' || page_id"
#: Pages of a synthetic vault, with a file for each page and a title for two of three.
_VAULT = """v AS (SELECT 'https://s/p/' || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN 'docs/' ELSE 'resources/' END || 'page-' || page_id AS url,
  CASE WHEN page_id % 3 < 2 THEN 'Title ' || page_id END AS title, 'docs/' || (page_id % 7) || '/Page ' || page_id || '.md' AS file_path, page_id AS ord FROM pages)"""


def _vault(spark, sf_dir):
    n = F.col("page_id")
    kind = F.when(n % 3 == 0, "").when(n % 3 == 1, "docs/").otherwise("resources/")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://s/p/"), kind, F.lit("page-"), n.cast("string")).alias("url"), F.when(n % 3 < 2, F.concat(F.lit("Title "), n.cast("string"))).alias("title"),
        F.concat(F.lit("docs/"), (n % 7).cast("string"), F.lit("/Page "), n.cast("string"), F.lit(".md")).alias("file_path"), n.alias("ord"),
    )


_LINKS = """l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://s/p/page-' || (event_id % 400) || '/' WHEN 1 THEN 'https://s/p/x-' || event_id WHEN 2 THEN 'https://other/' || event_id
  WHEN 3 THEN 'https://s/p/' ELSE 'https://s/p/docs/page-' || (event_id % 400) END AS url, 'title ' || (event_id % 300) AS text FROM events)"""


def _event_links(spark, sf_dir):
    n, k = F.col("event_id"), F.col("event_id") % 5
    mod = lambda m: (n % m).cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("https://s/p/page-"), mod(400), F.lit("/"))).when(k == 1, F.concat(F.lit("https://s/p/x-"), n.cast("string")))
        .when(k == 2, F.concat(F.lit("https://other/"), n.cast("string"))).when(k == 3, F.lit("https://s/p/")).otherwise(F.concat(F.lit("https://s/p/docs/page-"), mod(400)))
    )
    return table(spark, sf_dir, "events").select("event_id", url.alias("url"), F.concat(F.lit("title "), mod(300)).alias("text"))


@query(rf"""
WITH {_VAULT}, {_LINKS},
m AS (SELECT url AS k, replace(file_path, '.md', '') AS f FROM v), t AS (SELECT lower(title) AS k, replace(file_path, '.md', '') AS f FROM v WHERE title IS NOT NULL),
x AS (SELECT event_id, text, url, regexp_replace(url, '/+$', '') AS own, starts_with(url, '{BASE}') AS inside, regexp_replace(regexp_replace(url, '/+$', ''), '^{BASE}/?(docs/|resources/)?', '') AS rest FROM l)
SELECT event_id, CASE WHEN NOT inside THEN NULL ELSE coalesce(m1.f, CASE WHEN own = '{BASE}' THEN 'index' END, m2.f, m3.f, t.f, {_title_sql("list_extract(string_split(own, '/'), -1)")}) END AS target,
  CASE WHEN NOT inside THEN 'external' WHEN m1.f IS NOT NULL THEN 'exact' WHEN own = '{BASE}' THEN 'home' WHEN m2.f IS NOT NULL THEN 'docs' WHEN m3.f IS NOT NULL THEN 'resources' WHEN t.f IS NOT NULL THEN 'title' ELSE 'slug' END AS rule
FROM x LEFT JOIN m m1 ON inside AND m1.k = own LEFT JOIN m m2 ON inside AND m2.k = '{BASE}/docs/' || rest LEFT JOIN m m3 ON inside AND m3.k = '{BASE}/resources/' || rest LEFT JOIN t ON inside AND t.k = text
""")
def q_link_resolve(spark, sf_dir):
    return links.resolve(_event_links(spark, sf_dir), _vault(spark, sf_dir), BASE).select("event_id", "target", "rule")


@query(f"WITH {_VAULT} SELECT count(*) AS urls, count(DISTINCT lower(title)) AS titles, count(DISTINCT file_path) AS paths FROM v")
def q_mapping_stats(spark, sf_dir):
    return _vault(spark, sf_dir).agg(F.count("*").alias("urls"), F.countDistinct(F.lower("title")).alias("titles"), F.countDistinct("file_path").alias("paths"))


@query(f"""
WITH {_VAULT}, t AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'page-' || (event_id % 500) ELSE 'Page ' || (event_id % 500) END AS target FROM events)
SELECT target, min_by(replace(file_path, '.md', ''), ord) AS file FROM t JOIN v ON lower('Page ' || ord) = lower(target) OR lower('Page ' || ord) = lower(replace(target, '-', ' ')) OR contains(lower(url), lower(target)) GROUP BY target
""")
def q_wikilink_repair(spark, sf_dir):
    n = F.col("event_id")
    target = F.concat(F.when(n % 2 == 0, "page-").otherwise("Page "), (n % 500).cast("string"))
    return links.repair(table(spark, sf_dir, "events").select(target.alias("target")), _vault(spark, sf_dir))


@query(f"""
WITH {_VAULT}
SELECT ord AS doc_id, 'See [[' || CASE WHEN o.f IS NULL THEN '' ELSE o.f END || '|a b]] and [x](https://other/) end' AS text
FROM (SELECT v.ord, CASE WHEN n.ord % 7 = v.ord % 7 THEN 'Page ' || n.ord ELSE '../' || (n.ord % 7) || '/Page ' || n.ord END AS f FROM v JOIN v n ON n.ord = (v.ord + 1) % (SELECT count(*) FROM v)) o
""")
def q_wikilink_convert(spark, sf_dir):
    """Each page links to the next one by its URL and to another site; links become relative wikilinks."""
    v = _vault(spark, sf_dir)
    n = v.agg(F.count("*").alias("n"))
    next_url = v.select(F.col("ord").alias("_o"), F.col("url").alias("_u"))
    docs = v.join(n, F.lit(True)).withColumn("_o", (F.col("ord") + 1) % F.col("n")).join(next_url, "_o")
    docs = docs.select(F.col("ord").alias("doc_id"), "file_path", F.concat(F.lit("See [a b]("), "_u", F.lit("/) and [x](https://other/) end")).alias("text"))
    return links.convert(docs, v, BASE).select("doc_id", "text")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, 'images/' || (doc_id % 50) || '.png' AS l, 'https://i/' || (doc_id % 50) || '.png' AS u FROM documents)
SELECT doc_id, t || ' a ![[' || l || ']] ![[' || l || ']] ![[' || l || ']] <img src="' || l || '"> b ![y](https://i/none.png) ![[//i/' || (doc_id % 50) || '.png|z]] ' || t AS text FROM d
""")
def q_image_refs(spark, sf_dir):
    """Whole texts with references in all forms."""
    k = F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".png"))
    t = F.coalesce("text", F.lit(""))
    parts = (t, F.lit(" a ![x](https://i/"), k, F.lit(") ![](//i/"), k, F.lit(") ![[https://i/"), k, F.lit('|alt]] <img src="https://i/'), k, F.lit('"> b ![y](https://i/none.png) ![[//i/'), k, F.lit("|z]] "), t)
    docs = texts(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))
    images = spark.range(50).select(F.concat(F.lit("https://i/"), F.col("id").cast("string"), F.lit(".png")).alias("url"), F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".png")).alias("local_path"))
    return links.image_references(docs, images).select("doc_id", "text")


@query("""SELECT doc_id, 'x ' || coalesce(text, '') || ' [[guides/x-' || doc_id || '|Text]] [[resources/r|R]] [y](http://o/z)' AS text FROM documents""")
def q_slug_wikilinks(spark, sf_dir):
    text = F.concat(F.lit("x "), F.coalesce("text", F.lit("")), F.lit(" [Text](https://s/p/guides/x-"), F.col("doc_id").cast("string"), F.lit('/) [R](https://s/p/resources/r "t") [y](http://o/z)'))
    return texts(spark, sf_dir, "documents").select("doc_id", X.wikilinks(text, BASE).alias("text"))


@query("""SELECT doc_id, 'x ' || coalesce(text, '') || ' [[Get Started|T]] [[A to Z|u]] [[What is X ' || doc_id || '|A]] [[resources/R Y|B]] [[Q|C]] [[index|H]] [y](http://o/z)' AS text FROM documents""")
def q_titled_wikilinks(spark, sf_dir):
    """Bent wikilinks and links below the base behind the whole text of each document."""
    n = F.col("doc_id").cast("string")
    bent = F.lit(' [[get-started/ "u"|T]] [[a-to-z/|u]] [A](https://s/p/docs/what-is-x-')
    text = F.concat(F.lit("x "), F.coalesce("text", F.lit("")), bent, n, F.lit('/) [B](https://s/p/resources/r-y "t") [C](https://s/p/q) [H](https://s/p/) [y](http://o/z)'))
    return texts(spark, sf_dir, "documents").select("doc_id", X.titled_wikilinks(text, BASE).alias("text"))


@query(f"""
WITH {_VAULT}, n AS (SELECT count(*) AS c FROM v), o AS (SELECT v.ord, (v.ord * 3 + 1) % c AS m FROM v, n)
SELECT ord AS doc_id, 'See [[' || CASE WHEN m % 7 = ord % 7 THEN 'Page ' || m ELSE '../' || (m % 7) || '/Page ' || m END || '|next]] [[' || CASE WHEN m % 7 = ord % 7 THEN 'Page ' || m ELSE '../' || (m % 7) || '/Page ' || m END
  || '|by name]] [[nothing-here-' || ord || '|q]] [[a/b|c]]' AS text FROM o
""")
def q_wikilink_repair_docs(spark, sf_dir):
    """Each page links to another one by slug and by name, and to nothing."""
    v = _vault(spark, sf_dir)
    m = ((F.col("ord") * 3 + 1) % F.col("n")).cast("string")
    docs = v.join(v.agg(F.count("*").alias("n")), F.lit(True))
    docs = docs.select(F.col("ord").alias("doc_id"), "file_path", F.concat(F.lit("See [[page-"), m, F.lit("|next]] [[Page "), m, F.lit("|by name]] [[nothing-here-"), F.col("ord").cast("string"), F.lit("|q]] [[a/b|c]]")).alias("text"))
    return links.convert(docs, v, BASE).select("doc_id", "text")


@query("""
WITH RECURSIVE e AS (SELECT page_id AS src, page_id // 2 AS dst FROM pages WHERE page_id > 0),
w AS (SELECT page_id AS start, page_id AS cur, 0 AS hops FROM pages UNION ALL SELECT start, dst, hops + 1 FROM w JOIN e ON e.src = w.cur)
SELECT 'https://s/' || start AS url, 'https://s/' || arg_max(cur, hops) AS final, max(hops) AS hops FROM w GROUP BY start
""")
def q_redirect_closure(spark, sf_dir):
    """Every page redirects to the one with half its number, the sources written with a slash."""
    url = lambda c: F.concat(F.lit("https://s/"), F.col(c).cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 2).cast("long").alias("half"))
    edges = rows.where("page_id > 0").select(F.concat(url("page_id"), F.lit("/")).alias("src"), url("half").alias("dst"))
    return links.redirect_closure(rows.select(url("page_id").alias("url")), edges)


@query("SELECT 'https://s/' || page_id AS url, 'https://s/' || (page_id - page_id % 3 + (page_id % 3 + 2) % 3) AS final, 2 AS hops FROM pages WHERE page_id < (SELECT max(page_id) // 3 * 3 FROM pages)")
def q_redirect_loop(spark, sf_dir):
    """Threes of pages redirect in a circle; each path stops before it would come back."""
    rows = table(spark, sf_dir, "pages")
    most = rows.agg((F.floor(F.max("page_id") / 3) * 3).alias("most"))
    n = F.col("page_id")
    url = lambda c: F.concat(F.lit("https://s/"), c.cast("long").cast("string"))
    rows = rows.join(most, n < F.col("most")).select(url(n).alias("src"), url(n - n % 3 + (n % 3 + 1) % 3).alias("dst"))
    return links.redirect_closure(rows.select(F.col("src").alias("url")), rows)


@query("SELECT page_id, '---' || chr(10) || 'url: ' || url || chr(10) || 'redirect_to: https://s/' || chr(10) || '---' || chr(10) || chr(10) || 'This page has moved to [[Page ' || page_id || ']].' || chr(10) AS note FROM pages")
def q_redirect_note(spark, sf_dir):
    file = F.concat(F.lit("docs/Page "), F.col("page_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "pages").select("page_id", links.redirect_note(F.col("url"), F.lit("https://s/"), file).alias("note"))


# ---- names and index ----


@query("""
WITH s AS (SELECT event_id, 'docs/' || (user_id % 50) || '.md' AS path, event_type AS content FROM events),
f AS (SELECT *, first_value(content) OVER (PARTITION BY path ORDER BY event_id) AS f FROM s)
SELECT event_id, CASE WHEN content = f THEN path ELSE replace(path, '.md', '_' || CAST(sum(CASE WHEN content <> f THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) || '.md') END AS stored FROM f
""")
def q_dup_suffix(spark, sf_dir):
    path = F.concat(F.lit("docs/"), (F.col("user_id") % 50).cast("string"), F.lit(".md"))
    saves = table(spark, sf_dir, "events").select("event_id", path.alias("path"), F.col("event_type").alias("content"))
    return index.duplicate_names(saves, "path", "content", "event_id").select("event_id", "stored")


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def q_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def _index_pages(spark, sf_dir):
    n = F.col("page_id")
    path = F.concat(F.when(n % 4 == 0, "guide/").otherwise("docs/"), F.when(n % 3 == 0, "").otherwise(F.concat((n % 3).cast("string"), F.lit("/"))), F.lit("P"), n.cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "pages").select(F.col("url"), F.concat(F.lit("T"), n.cast("string")).alias("title"), path.alias("file_path"), F.when(n % 5 == 0, "failed").otherwise("completed").alias("status"))


_INDEX = "i AS (SELECT page_id AS n, CASE WHEN page_id % 3 = 0 THEN '' ELSE (page_id % 3) || '/' END AS d FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0)"


@query(f"""
WITH {_INDEX}
SELECT '1docs/' || CASE WHEN d = '' THEN '0' ELSE '1' || d || '0' END || 'P' || n || '.md' AS sort, 'page' AS kind, '- [[docs/' || d || 'P' || n || '|T' || n || ']]' AS line FROM i
UNION ALL SELECT DISTINCT '1docs/1' || replace(d, '/', ''), 'folder', '### ' || replace(d, '/', '') FROM i WHERE d <> '' UNION ALL SELECT '1docs', 'folder', '## docs'
""")
def q_index_lines(spark, sf_dir):
    return index.index_lines(_index_pages(spark, sf_dir))


@query(f"""WITH {_INDEX} SELECT count(*) AS total FROM i""")
def q_index_count(spark, sf_dir):
    return index.listed(_index_pages(spark, sf_dir)).agg(F.count("*").alias("total"))


@query(f"""
WITH {_INDEX}, l AS (
SELECT '1docs/' || CASE WHEN d = '' THEN '0' ELSE '1' || d || '0' END || 'P' || n || '.md' AS sort, '- [[docs/' || d || 'P' || n || '|T' || n || ']]' AS line FROM i
UNION ALL SELECT DISTINCT '1docs/1' || replace(d, '/', ''), '### ' || replace(d, '/', '') FROM i WHERE d <> '' UNION ALL SELECT '1docs', '## docs')
SELECT '# Table of Contents' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY sort, line) || chr(10) || chr(10) || '---' || chr(10) || 'Total documentation pages: ' || (SELECT count(*) FROM i) || chr(10) AS text FROM l
""")
def q_index_document(spark, sf_dir):
    return index.index_document(_index_pages(spark, sf_dir))


# ---- lint ----

_LINES = r"""
t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, list_transform(l, lambda x, i: CASE i % 8 WHEN 1 THEN '# ' || x WHEN 2 THEN '  - ' || x WHEN 3 THEN '3. ' || x WHEN 4 THEN '> ' || x WHEN 5 THEN x || '  ' WHEN 6 THEN '' WHEN 7 THEN '5. ' || x ELSE x || ' <b>y</b>' END) AS l FROM t),
n AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INT) AS i FROM s)"""


def _synthetic(spark, sf_dir):
    """Documents whose lines take turns as heading, bullet, number, callout, trailing blanks, blank, number and HTML."""

    def put(x, i):
        k = (i + 1) % 8
        out = F.when(k == 1, F.concat(F.lit("# "), x)).when(k == 2, F.concat(F.lit("  - "), x)).when(k == 3, F.concat(F.lit("3. "), x)).when(k == 4, F.concat(F.lit("> "), x))
        return out.when(k == 5, F.concat(x, F.lit("  "))).when(k == 6, F.lit("")).when(k == 7, F.concat(F.lit("5. "), x)).otherwise(F.concat(x, F.lit(" <b>y</b>")))

    return texts(spark, sf_dir, "documents").select("doc_id", F.transform(lint.lines(F.col("text")), put).alias("l"))


@query(rf"WITH {_LINES} SELECT doc_id, i AS line_number, line AS original, regexp_replace(line, '[ \t\r\f\x0B]+$', '') AS fixed FROM n WHERE regexp_matches(line, '[ \t\r\f\x0B]$')")
def q_lint_trailing_whitespace(spark, sf_dir):
    return lint.line_issues(_synthetic(spark, sf_dir), "doc_id", "l", lint.without_trailing)


@query(rf"WITH {_LINES} SELECT doc_id, i AS line_number, line AS original, regexp_replace(line, '^[ \t]+([-*+])[ \t]+(.*)$', '\1 \2') AS fixed FROM n WHERE regexp_matches(line, '^[ \t]+[-*+][ \t]')")
def q_lint_list_indentation(spark, sf_dir):
    return lint.line_issues(_synthetic(spark, sf_dir), "doc_id", "l", lint.at_column_zero)


@query(rf"WITH {_LINES} SELECT doc_id, i AS line_number, line AS original, regexp_replace(line, '<b>(.*?)</b>', '**\1**', 'g') AS fixed FROM n WHERE contains(line, '<b>')")
def q_lint_inline_html(spark, sf_dir):
    return lint.line_issues(_synthetic(spark, sf_dir), "doc_id", "l", lint.without_html)


@query(rf"""WITH {_LINES}, w AS (SELECT *, lag(line) OVER o AS b, lead(line) OVER o AS a FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, i AS line_number, side FROM (SELECT *, 'before' AS side FROM w WHERE b IS NOT NULL AND trim(b) <> '' UNION ALL SELECT *, 'after' FROM w WHERE a IS NOT NULL AND trim(a) <> '') WHERE regexp_matches(line, '^#{{1,6}}\s+')""")
def q_lint_heading_spacing(spark, sf_dir):
    rows = _synthetic(spark, sf_dir).select("doc_id", F.explode(lint.neighbours(F.col("l"))).alias("n")).where(F.col("n.line").rlike(lint.HEADING))
    misses = lambda c, side: F.when(c.isNotNull() & (F.trim(c) != ""), F.lit(side))
    return rows.select("doc_id", F.col("n.i").alias("line_number"), F.explode(F.array_compact(F.array(misses(F.col("n.before"), "before"), misses(F.col("n.after"), "after")))).alias("side"))


@query(rf"""WITH {_LINES}, k AS (SELECT *, regexp_matches(trim(line), '^\d+\.\s+') AS item, trim(line) = '' AS blank FROM n),
g AS (SELECT *, sum(CASE WHEN NOT item AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k),
r AS (SELECT *, CAST(sum(CASE WHEN item THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY i) AS INT) AS number FROM g)
SELECT doc_id, i AS line_number, number FROM r WHERE item AND CAST(regexp_extract(trim(line), '^(\d+)', 1) AS INT) <> number""")
def q_lint_numbered_list_sequence(spark, sf_dir):
    rows = _synthetic(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip(F.col("l").alias("line"), lint.numbers(F.col("l")).alias("number"))).alias("i", "z"))
    told = F.regexp_extract(F.trim("z.line"), r"^(\d+)", 1)
    return rows.where(F.col("z.number").isNotNull()).where(told.try_cast("int") != F.col("z.number")).select("doc_id", (F.col("i") + 1).alias("line_number"), F.col("z.number").alias("number"))


@query("SELECT doc_id, CAST(0 AS INT) AS line_number FROM documents WHERE contains(text || CASE WHEN doc_id % 2 = 0 THEN repeat(chr(10), 3) ELSE chr(10) END || 'x', repeat(chr(10), 3))")
def q_lint_multiple_blank_lines(spark, sf_dir):
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n\n")).otherwise(F.lit("\n")), F.lit("x"))
    rows = texts(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return rows.where(F.regexp_replace("t", r"\n{3,}", "\n\n") != F.col("t")).select("doc_id", F.lit(0).alias("line_number"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line_number FROM documents WHERE text <> '' AND NOT ends_with(text, chr(10))")
def q_lint_missing_final_newline(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").where((text != "") & ~text.endswith("\n"))
    return rows.select("doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line_number"))


#: A block for each rule, put before the whole text of each document, and what the rule makes of it.
_RULES = {
    "content_before_h1": ("x\n# h\ny {}\n", "# h\ny {}\n"),
    "multiline_wiki_link": ("[[a|b\nc {}]] ", "[[a|b c {}]] "),
    "malformed_wikilink": ('[[a/"|b {}]] ', "[[a|b {}]] "),
    "internal_link_format": ("[b](a.md) {} ", "[[a|b]] {} "),
    "table_missing_header": ("| a | b |\n| --- |\n{}\n", "|  |  |\n| --- | --- |\n| a | b |\n| --- |\n{}\n"),
    "callout_empty_line": ("  > a\n\n> {}\nx\n", "  > a\n>\n> {}\nx\n"),
    "list_empty_lines": ("- a\n\n- {}\nx\n", "- a\n- {}\nx\n"),
    "numbered_list_sequence": ("01.  a\n\n7. b {}\nx\n", "1. a\n\n2. b {}\nx\n"),
}


def _put(block: str) -> str:
    """A block as SQL, with the document's id in it."""
    return "'" + block.replace("\n", "' || chr(10) || '").replace("{}", "' || doc_id || '") + "'"


def _rule(name: str):
    def run(spark, sf_dir):
        before, after = _RULES[name][0].split("{}")
        docs = texts(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after), F.coalesce("text", F.lit(""))).alias("text"))
        linted = lint.lint(docs, "doc_id", passes=(getattr(lint, name),))
        return linted.where(F.exists("issues", lambda i: i["issue_type"] == name)).select("doc_id", "fixed")

    run.__name__ = f"q_lint_{name}" if name != "numbered_list_sequence" else "q_lint_numbered_list_rewrite"
    return run


for _name, (_, _fixed) in _RULES.items():
    query(f"SELECT doc_id, {_put(_fixed)} || coalesce(text, '') AS fixed FROM documents")(_rule(_name))


def _linted(spark, sf_dir, passes=lint.PASSES):
    docs = _synthetic(spark, sf_dir).select("doc_id", F.array_join("l", "\n").alias("text"))
    return lint.issues(lint.lint(docs, "doc_id", passes=passes), "doc_id")


_THREE = rf"""{_LINES}, trimmed AS (SELECT *, regexp_replace(line, '[ \t\r\f\x0B]+$', '') AS bare FROM n),
told AS (SELECT 'trailing_whitespace' AS issue_type, doc_id, i FROM trimmed WHERE line <> bare UNION ALL SELECT 'list_indentation', doc_id, i FROM trimmed WHERE regexp_matches(bare, '^[ \t]+[-*+][ \t]')
  UNION ALL SELECT 'missing_final_newline', doc_id, 2147483647 FROM trimmed WHERE i = (SELECT max(i) FROM trimmed x WHERE x.doc_id = trimmed.doc_id) AND bare <> '')"""


@query(f"WITH {_THREE} SELECT issue_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, issue_type) AS INT) AS rank FROM told GROUP BY issue_type")
def q_lint_type_counts(spark, sf_dir):
    """Three rules one after the other on whole documents: issues of each type, the commonest first."""
    return lint.counts(_linted(spark, sf_dir, (lint.trailing_whitespace, lint.list_indentation, lint.missing_final_newline)), "doc_id")


@query(f"WITH {_THREE} SELECT count(DISTINCT doc_id) AS files, count(*) AS issues FROM told")
def q_lint_totals(spark, sf_dir):
    return lint.totals(_linted(spark, sf_dir, (lint.trailing_whitespace, lint.list_indentation, lint.missing_final_newline)), "doc_id")


@query()
def q_lint_counts(spark, sf_dir):
    return lint.counts(_linted(spark, sf_dir), "doc_id")


@query()
def q_lint_report(spark, sf_dir):
    return lint.report_lines(_linted(spark, sf_dir), "doc_id")
