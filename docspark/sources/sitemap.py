"""Sitemaps, hierarchies in embedded state, and vault folders as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from docspark.functions import url as U


def is_xml(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("<?xml"))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """url, lastmod of sitemap files, lastmod as text; entries without a location are left out."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.where(F.trim("loc") != "").select(F.trim("loc").alias("url"), "lastmod")


def entries(xml: Column) -> Column:
    """array of locations in a sitemap's text, by XPath without regard to its namespace."""
    return F.xpath(xml, F.lit("//*[local-name()='loc']/text()"))


def locations(xml: Column) -> Column:
    """The same by pattern, for texts that are no well-formed XML."""
    return F.regexp_extract_all(xml, F.lit("<loc>(.*?)</loc>"), F.lit(1))


def first_source(rows: DataFrame, rank: str) -> DataFrame:
    """Rows of the best-ranked source that has any."""
    best = rows.agg(F.min(rank).alias("_best"))
    return rows.join(F.broadcast(best), F.col(rank) == F.col("_best")).drop("_best")


def prioritised(urls: DataFrame) -> DataFrame:
    return urls.withColumn("priority", U.priority(F.col("url")))


def kind_counts(urls: DataFrame) -> DataFrame:
    """One row: URLs, and how many of them are docs and resources."""
    of = lambda kind: F.count_if(F.col("url").contains(f"/{kind}/")).alias(kind)
    return urls.agg(F.count("url").alias("urls"), of("docs"), of("resources"))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of all .md files below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


_NODE = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "id", "title", "description", "parent")] + [T.StructField("depth", T.IntegerType()), T.StructField("ordinal", T.IntegerType()), T.StructField("mapped", T.BooleanType())])


@udtf(returnType=_NODE)
class Hierarchy:
    """Nodes of the navigation in an embedded state's JSON: childList entries, which are mapped, then navigation and other entries.

    A node counts if it has a slug or URL that starts with root; nodes below one that doesn't still count.
    """

    def eval(self, state: str, root: str):
        try:
            data = json.loads(state or "")
        except ValueError:
            return
        if not isinstance(data, dict):
            return
        n = 0
        sources = [(data.get("navigation"), False)]
        entry = data.get("entry")
        sources += [((entry or {}).get("childList") if isinstance(entry, dict) else None, True)]
        sources += [(data.get(k), False) for k in ("allEntries", "entries", "pages")]
        for source, mapped in sources:
            stack = [(x, None, 0) for x in reversed(source if isinstance(source, list) else [])]
            while stack:
                node, parent, depth = stack.pop()
                if not isinstance(node, dict):
                    continue
                slug = next((node[k] for k in (("slug",) if mapped else ("url", "href", "slug")) if isinstance(node.get(k), str) and node[k]), "")
                url = slug if slug.startswith(("http://", "https://")) else root.rstrip("/") + "/" + slug.lstrip("/") if slug else ""
                own = url if url.startswith(root) else None
                if own:
                    yield own, str(node.get("id") or ""), str(node.get("title") or ""), str(node.get("description") or ""), parent, depth, n, mapped
                    n += 1
                below = node.get("childList") if mapped else next((node[k] for k in ("children", "items", "childList") if isinstance(node.get(k), list)), None)
                stack += [(c, own or parent, depth + 1) for c in reversed(below if isinstance(below, list) else [])]


def breadcrumbs(json_ld: Column) -> Column:
    """array<struct<position,name,url>> of a JSON-LD list, by position; equal positions keep their order."""
    kind = "struct<`@type`:string,itemListElement:array<struct<position:int,item:struct<name:string,`@id`:string>>>>"
    data = F.from_json(json_ld, kind)
    found = F.filter(data["itemListElement"], lambda e: e["item"].isNotNull())
    keyed = F.transform(found, lambda e, i: F.struct(F.coalesce(e["position"], F.lit(0)).alias("position"), i.alias("i"), F.coalesce(e["item"]["name"], F.lit("")).alias("name"), F.coalesce(e["item"]["@id"], F.lit("")).alias("url")))
    return F.when(data["@type"] == "BreadcrumbList", F.transform(F.array_sort(keyed), lambda e: F.struct(e["position"].alias("position"), e["name"].alias("name"), e["url"].alias("url"))))
