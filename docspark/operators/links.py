"""The link graph: redirects, maps from URLs and titles to files, links resolved by joins and put back into their texts."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import path as P
from docspark.functions.url import quoted
from docspark.operators.lineage import cut

LINK = r"\[([^\]]+)\]\(([^)]+)\)"
WIKILINK = r"\[\[([^|]+?)\|([^\]]+)\]\]"
#: Broadcast a map only up to this many rows; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
#: Turns of an iteration whose results are merged in one table.
MERGED = 32


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def next_hops(redirects: DataFrame, order: str | None = None) -> DataFrame:
    """cur, nxt: where a URL goes in one hop. Its own redirect counts first, then that of its form with a slash, then without. Of
    redirects that conflict the latest by `order` counts; without an order the largest."""
    latest = F.max("dst") if order is None else F.max(F.struct(order, "dst"))["dst"]
    known = redirects.where("src is not null and dst is not null").groupBy("src").agg(latest.alias("dst"))
    bare = trimmed(F.col("src"))
    forms = known.select(bare.alias("_k"), (F.col("src") == bare).alias("_plain"), trimmed(F.col("dst")).alias("_d"))
    both = forms.groupBy("_k").agg(F.max(F.when(F.col("_plain"), F.col("_d"))).alias("_p"), F.max(F.when(~F.col("_plain"), F.col("_d"))).alias("_s"))
    plain = both.select(F.col("_k").alias("cur"), F.coalesce("_p", "_s").alias("nxt"))
    return plain.union(both.select(F.concat("_k", F.lit("/")).alias("cur"), F.coalesce("_s", "_p").alias("nxt")))


def redirect_closure(starts: DataFrame, redirects: DataFrame, order: str | None = None) -> DataFrame:
    """starts(url), redirects(src, dst) -> url, final, hops. Targets lose their slash; a URL without a redirect stays as it is;
    loops stop before the first repetition. Paths may be of any length.

    Each turn is one join of the paths that still move, written out so that plans stay short and finished paths are done with.
    """
    edges = cut(next_hops(redirects, order))
    now = starts.where("url is not null").distinct().select("url", F.col("url").alias("final"), F.lit(0).alias("hops"), F.array(trimmed(F.col("url"))).alias("seen"))
    done = []
    while True:
        step = cut(now.join(edges.withColumnRenamed("cur", "final"), "final", "left").withColumn("goes", F.col("nxt").isNotNull() & ~F.array_contains("seen", F.coalesce("nxt", F.lit("")))))
        done.append(step.where("not goes").select("url", F.when(F.col("nxt").isNotNull(), trimmed(F.col("final"))).otherwise(F.col("final")).alias("final"), "hops"))
        now = step.where("goes").select("url", F.col("nxt").alias("final"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("nxt")).alias("seen"))
        if now.isEmpty():
            return reduce(DataFrame.union, done)
        if len(done) % MERGED == 0:
            done = [cut(reduce(DataFrame.union, done))]


def closure_sql(edges: str, starts: str, depth: int = 50) -> str:
    """The same closure as one recursive query: edges(src, dst) with plain keys, starts(url); the deepest row of each path counts."""
    return f"""
    WITH RECURSIVE walk(url, final, hops, seen) MAX RECURSION LEVEL {depth} AS (
      SELECT url, url, 0, array(url) FROM {starts}
      UNION ALL
      SELECT w.url, e.dst, w.hops + 1, array_append(w.seen, e.dst) FROM walk w JOIN {edges} e ON e.src = w.final
      WHERE NOT array_contains(w.seen, e.dst) AND w.hops < {depth - 1})
    SELECT url, max_by(final, hops) AS final, max(hops) AS hops FROM walk GROUP BY url"""


def url_map(pages: DataFrame) -> DataFrame:
    """pages(url, title, file_path, ord) -> _key (URL without slash), _file (path without extension), _title, _name, ord."""
    rows = pages.where("url is not null and file_path is not null")
    return rows.select(trimmed(F.col("url")).alias("_key"), P.without_suffix(F.col("file_path")).alias("_file"), F.nullif(F.lower(F.trim("title")), F.lit("")).alias("_title"), P.stem(F.col("file_path")).alias("_name"), "ord")


def _last(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The last value of each key by ord: later pages overwrite earlier ones."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, "ord").alias(name))


def _sized(rows: DataFrame) -> DataFrame:
    """A broadcast hint if few rows are left, by a count that stops at the bound."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def resolve(links: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """links(url, text, ...) with `target` (a file without extension, null for external links), `rule` and the wikilink's `slug`.

    In order: the URL itself; below base/docs or base/resources; a title equal to the text of more than three characters; the
    slug. The home page of base is `index`. Only distinct targets are resolved, then joined back.
    """
    mapped = url_map(pages)
    by_url = _sized(_last(mapped, "_key", "_file", "_hit"))
    by_title = _sized(_last(mapped, "_title", "_file", "_hit"))
    base = base.rstrip("/")
    wanted = links.select("url", "text").distinct()
    rest = F.regexp_replace(trimmed(F.col("url")), "^" + quoted(base) + "/?(docs/|resources/)?", "")
    rows = wanted.withColumns({"_own": trimmed(F.col("url")), "_rest": rest, "_inside": F.col("url").startswith(base)})
    for name, key in (("_h1", F.col("_own")), ("_h2", F.concat(F.lit(base + "/docs/"), F.col("_rest"))), ("_h3", F.concat(F.lit(base + "/resources/"), F.col("_rest")))):
        rows = rows.withColumn("_k", F.when(F.col("_inside"), key)).join(by_url.select(F.col("_key").alias("_k"), F.col("_hit").alias(name)), "_k", "left").drop("_k")
    told = F.lower(F.trim("text"))
    rows = rows.withColumn("_k", F.when(F.col("_inside") & (F.length("text") > 3), told)).join(by_title.select(F.col("_title").alias("_k"), F.col("_hit").alias("_h4")), "_k", "left").drop("_k")
    home = F.col("_own") == base
    slug = F.when(F.col("_rest") == "", F.lit("index")).otherwise(P.slug_title(P.last_segment(F.col("_own"))))
    rows = rows.withColumns({
        "target": F.when(~F.col("_inside"), None).otherwise(F.coalesce("_h1", F.when(home, F.lit("index")), "_h2", "_h3", "_h4", slug)),
        "rule": F.when(~F.col("_inside"), "external").when(F.col("_h1").isNotNull(), "exact").when(home, "home").when(F.col("_h2").isNotNull(), "docs").when(F.col("_h3").isNotNull(), "resources").when(F.col("_h4").isNotNull(), "title").otherwise("slug"),
    }).select("url", "text", "target", "rule")
    return links.join(rows.withColumnRenamed("url", "_u").withColumnRenamed("text", "_t"), F.col("url").eqNullSafe(F.col("_u")) & F.col("text").eqNullSafe(F.col("_t")), "left").drop("_u", "_t")


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def containing(targets: DataFrame, urls: DataFrame) -> DataFrame:
    """targets(target), urls(_url, ...) -> target and the columns of urls that contain it. Each target meets the URLs by the rarest of its
    runs of three characters (of its own length, if shorter), so that no pair is made without one in common."""
    size = F.least(F.length("target"), F.lit(3))
    wanted = targets.select("target", size.alias("_n"), F.explode(F.when(size == 3, grams(F.col("target"), 3)).otherwise(F.array("target"))).alias("_g"))
    lengths = F.array(*(grams(F.col("_url"), n) for n in (1, 2, 3)))
    posted = urls.select("*", F.explode(F.array_distinct(F.flatten(lengths))).alias("_g"))
    often = posted.join(wanted.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_c"))
    rarest = wanted.join(often, "_g", "left").groupBy("target").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), "_g")).alias("r")).select("target", "r._g")
    return posted.join(rarest, "_g").where(F.col("_url").contains(F.col("target"))).drop("_g")


def repair(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """targets(target) without a slash -> target, file: the first page, in the order of ord, whose file name is the target or its
    title, or whose URL contains it. Names meet in an equi-join, URLs by runs of characters."""
    mapped = url_map(pages)
    wanted = targets.where("instr(target, '/') = 0 and target <> ''").select("target").distinct().withColumns({"_low": F.lower("target"), "_titled": F.lower(P.slug_title(F.col("target")))})
    names = mapped.select(F.lower("_name").alias("_n"), "_file", "ord")
    by_name = wanted.select("target", F.explode(F.array_distinct(F.array("_low", "_titled"))).alias("_n")).join(names, "_n").select("target", "_file", "ord")
    by_url = containing(wanted.select("target"), mapped.select(F.lower("_key").alias("_url"), "_file", "ord")).select("target", "_file", "ord")
    return by_name.union(by_url).groupBy("target").agg(F.min_by("_file", "ord").alias("file"))


def repaired(docs: DataFrame, pages: DataFrame, key: str = "doc_id", checks: DataFrame | None = None, base: str = "") -> DataFrame:
    """docs(key, file_path, text) with the wikilinks whose target has no slash led to the page that repair() finds, or else to the one that
    verified() finds among checks(url, final_url), relative to the document's own file. Other wikilinks stay as they are."""
    m = F.regexp_extract_all(F.col("text"), F.lit(WIKILINK), F.lit(0))
    part = lambda k: F.trim(F.regexp_extract("_m", WIKILINK, k))
    own = docs.select(key, F.posexplode(m).alias("ord", "_m")).select(key, "ord", "_m", part(1).alias("target"), part(2).alias("told"))
    files = repair(own.select("target"), pages)
    if checks is not None:
        rest = own.where("instr(target, '/') = 0").select("target").distinct().join(files, "target", "left_anti")
        files = files.union(verified(rest, checks, pages, base))
    led = own.join(files, "target", "left")
    parts = led.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "_m", "told", "file"))).alias("_links"))
    put = F.transform("_links", lambda l: F.when(l["file"].isNull(), l["_m"]).otherwise(F.concat(F.lit("[["), P.relative(F.col("file_path"), l["file"]), F.lit("|"), l["told"], F.lit("]]"))))  # noqa: E741
    return _put_back(docs.join(parts, key, "left"), WIKILINK, put, "_links")


def _put_back(rows: DataFrame, pattern: str, put: Column, links: str) -> DataFrame:
    """text with its matches of the pattern replaced in order by the array `put`; rows without `links` stay."""
    joined = F.array_join(F.flatten(F.zip_with(F.split("text", pattern, -1), put, lambda a, m: F.array(F.coalesce(a, F.lit("")), F.coalesce(m, F.lit(""))))), "")
    return rows.withColumn("text", F.when(F.col(links).isNotNull(), joined).otherwise(F.col("text"))).drop(links)


def found_links(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, text, url of each Markdown link, in order."""
    m = F.regexp_extract_all(F.col(text), F.lit(LINK), F.lit(0))
    return docs.select(key, F.posexplode(m).alias("ord", "_m")).select(key, "ord", F.regexp_extract("_m", LINK, 1).alias("text"), F.regexp_extract("_m", LINK, 2).alias("url"))


def convert(docs: DataFrame, pages: DataFrame, base: str, key: str = "doc_id", checks: DataFrame | None = None) -> DataFrame:
    """docs(key, file_path, text): wikilinks are repaired first, then the text's links below base become wikilinks, relative to the
    document's own file."""
    docs = cut(repaired(docs, pages, key, checks, base))
    resolved = resolve(found_links(docs, key), pages, base)
    parts = resolved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "url", "text", "target"))).alias("_links"))
    put = F.transform("_links", lambda l: F.when(l["target"].isNull(), F.concat(F.lit("["), l["text"], F.lit("]("), l["url"], F.lit(")"))).otherwise(F.concat(F.lit("[["), P.relative(F.col("file_path"), l["target"]), F.lit("|"), l["text"], F.lit("]]"))))  # noqa: E741
    return _put_back(docs.join(parts, key, "left"), LINK, put, "_links")


#: The forms of an image reference: `![alt](url)`, `![[url|alt]]`, `src="url"`.
IMAGE_FORMS = (r"!\[[^\]]*\]\(([^)\s]+)\)", r"!\[\[([^|\]]+)\|[^\]]*\]\]", r'src="([^"]*)"')


def image_references(docs: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, text) with references to stored images(url, local_path) led to their files: `![alt](url)`, also with the URL's form
    without a protocol, and `![[url|alt]]` become `![[local]]`, `src="url"` becomes `src="local"`. The references of a text meet the map by
    an equi-join, never every image every text. Of images with one URL the smallest path counts."""
    pattern = "|".join(IMAGE_FORMS)
    m = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    plain, wiki, html = (F.regexp_extract("_m", "^(?:" + form + ")$", 1) for form in IMAGE_FORMS)
    refs = docs.select(key, F.posexplode(m).alias("ord", "_m"))
    refs = refs.select(key, "ord", "_m", F.coalesce(F.nullif(plain, F.lit("")), F.nullif(wiki, F.lit("")), html).alias("_k"), (plain != "").alias("_plain"), F.col("_m").startswith("src=").alias("_html"))
    known = images.where("url is not null and local_path is not null").groupBy(F.col("url").alias("_k")).agg(F.min("local_path").alias("local_path"))
    bare = known.where(F.col("_k").rlike("^https?://")).groupBy(F.regexp_replace("_k", "^https?:", "").alias("_k")).agg(F.min("local_path").alias("_bare"))
    hit = refs.join(known, "_k", "left").join(bare, "_k", "left").withColumn("_local", F.coalesce("local_path", F.when(F.col("_plain"), F.col("_bare"))))
    put = F.when(F.col("_local").isNull(), F.col("_m")).when(F.col("_html"), F.concat(F.lit('src="'), "_local", F.lit('"'))).otherwise(F.concat(F.lit("![["), "_local", F.lit("]]")))
    parts = hit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", put.alias("put")))).alias("_refs"))
    return _put_back(docs.join(parts, key, "left"), pattern, F.col("_refs.put"), "_refs")


def redirect_note(source: Column, final: Column, file: Column) -> Column:
    """The file that stands in for a redirected page."""
    name = P.stem(file)
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("url: "), source), F.concat(F.lit("redirect_to: "), final), F.lit("---"), F.lit(""), F.concat(F.lit("This page has moved to [["), name, F.lit("]].")), F.lit(""))


def canonical_files(starts: DataFrame, redirects: DataFrame, files: DataFrame) -> DataFrame:
    """starts(url), files(url, file_path) -> url, file_path of the page at the end of its redirects; null if none is known."""
    ends = redirect_closure(starts, redirects)
    known = files.where("file_path is not null").groupBy(trimmed(F.col("url")).alias("_k")).agg(F.max("file_path").alias("file_path"))
    return ends.withColumn("_k", trimmed(F.col("final"))).join(known, "_k", "left").select("url", "final", "file_path")


def already_done(fetched: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of fetched(url, final_url, ...) whose final URL is another page that is completed already."""
    done = pages.where("status = 'completed'").select(trimmed(F.col("url")).alias("_done")).distinct()
    return fetched.where(trimmed(F.col("url")) != trimmed(F.col("final_url"))).join(done, trimmed(F.col("final_url")) == F.col("_done"), "left_semi")


def with_metadata(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """pages with title and description of the hierarchy's node at their URL, empty where there is none."""
    last = nodes.groupBy(trimmed(F.col("url")).alias("_k")).agg(F.max_by(F.struct("title", "description"), "ordinal").alias("_n"))
    joined = pages.withColumn("_k", trimmed(F.col("url"))).join(last, "_k", "left")
    return joined.withColumns({"title": F.coalesce("_n.title", F.lit("")), "description": F.coalesce("_n.description", F.lit(""))}).drop("_k", "_n")


def verified(targets: DataFrame, checks: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """targets(target) that no page's name fits -> target, file: of four URLs, below docs and resources with and without a slash, the
    first that checks(url, final_url) found alive and whose final URL has a page."""
    base = base.rstrip("/")
    urls = F.array(*(F.concat(F.lit(f"{base}/{folder}/"), F.col("target"), F.lit(end)) for folder in ("docs", "resources") for end in ("/", "")))
    tries = targets.select("target").distinct().select("target", F.posexplode(urls).alias("rank", "url"))
    alive = tries.join(checks.where("final_url is not null"), "url").withColumn("_key", trimmed(F.col("final_url")))
    return alive.join(_last(url_map(pages), "_key", "_file", "file"), "_key").groupBy("target").agg(F.min_by("file", "rank").alias("file"))


def reachable(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Breadth first: starts(url), edges(parent_url, url) -> url, depth, each URL once at its least depth, down to `depth` if given.

    Each turn joins the newest URLs with the edges and leaves out what is known; it ends when nothing is new.
    """
    known = cut(starts.where("url is not null").select("url").distinct().withColumn("depth", F.lit(0)))
    newest, all_of = known, [known]
    for d in count(1) if depth is None else range(1, depth + 1):
        found = newest.select(F.col("url").alias("parent_url")).join(edges, "parent_url").select("url").distinct()
        newest = cut(found.join(reduce(DataFrame.union, all_of).select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if newest.isEmpty():
            break
        all_of.append(newest)
    return reduce(DataFrame.union, all_of)
