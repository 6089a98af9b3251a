"""URL algebra as Column expressions."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin as _urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that normalisation drops.
DROPPED_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "ref")
#: Paths that are no documentation, as regular expressions without regard to case.
EXCLUDED_PATHS = ("/api/", "/rest/", r"\.pdf$", r"\.zip$", "/download/", "/attachments/", "/login", "/signup")
#: Keywords of the priorities 1 to 4; anything else is 5.
PRIORITY_WORDS = (
    ("get-started", "overview", "what-is", "introduction"),
    ("setup", "install", "configure", "sign-up"),
    ("features", "basics", "fundamentals"),
    ("how-to", "guide", "tutorial"),
)


def quoted(text: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def origin(url: Column) -> Column:
    """Scheme and host, without a slash."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*#(.*)$", 1)


def normalize(url: Column) -> Column:
    """Without fragment, without the path's trailing slashes (unless the path is `/`), and without tracking parameters.

    Parameters without a value go; of equal keys the first place and the last value stay; values may hold `=`.
    """
    bare = F.concat(origin(url), F.when(path(url) == "/", F.lit("/")).otherwise(F.regexp_replace(path(url), "/+$", "")))
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: F.instr(p, "=") > 0),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")),
    )
    pairs = F.filter(pairs, lambda p: ~p["k"].isin(*DROPPED_PARAMETERS))
    kept = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    told = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), F.try_element_at(F.filter(pairs, lambda q: q["k"] == p["k"]), F.lit(-1))["v"])), "&")
    return F.concat(bare, F.when(told != "", F.concat(F.lit("?"), told)).otherwise(F.lit("")))


@F.pandas_udf(StringType())
def join(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 in full; for dot segments, which absolute() leaves as they are."""
    return pd.Series([None if b is None or h is None else _urljoin(b, h) for b, h in zip(base, href, strict=True)])


def absolute(base: Column, href: Column) -> Column:
    """href as seen from base, for references without dot segments; stays in generated code."""
    folder = F.concat(origin(base), F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_replace(path(base), "[^/]*$", "")))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def sibling_url(base: Column, href: Column) -> Column:
    """Empty stays empty, absolute stays, `/x` hangs on the origin, anything else on base with a slash between."""
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(""))
        .when(href.rlike("^https?://"), href)
        .when(href.startswith("/"), F.concat(origin(base), href))
        .otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), href))
    )


def slug_url(slug: Column, root: str, base: str, rooted: tuple[str, ...] = ()) -> Column:
    """A slug below base; below root for slugs that start with one of `rooted`, such as a product's own name."""
    bare = F.regexp_replace(slug, "^/+", "")
    at_root = reduce(lambda a, p: a | bare.startswith(p), rooted, F.lit(False))
    return F.when(bare.rlike("^https?://"), bare).when(at_root, F.concat(F.lit(root.rstrip("/") + "/"), bare)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), bare))


def product(url: Column) -> Column:
    """The first segment of the path, empty if there is none."""
    return F.split_part(F.regexp_replace(path(url), "^/+|/+$", ""), F.lit("/"), F.lit(1))


def priority(url: Column) -> Column:
    low = F.lower(url)
    out = None
    for n, words in enumerate(PRIORITY_WORDS, 1):
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(5)


def allowed(url: Column, mode: str, root: str, base: str, off_needs_root: bool = False) -> Column:
    """Domain restriction: `off` lets all through (or all of root), `product` what starts with base, `any` what starts with root;
    any other mode counts as product."""
    if mode == "off":
        return url.startswith(root) if off_needs_root else F.lit(True)
    return url.startswith(root) if mode.startswith("any") else url.startswith(root) & url.startswith(base)


def sitemap_wanted(url: Column, mode: str, root: str, base: str, include_resources: bool = True) -> Column:
    """Of a sitemap: in root, allowed by mode, and a docs page, or a resource if asked. Unknown modes keep nothing."""
    if mode not in ("off", "product") and not mode.startswith("any"):
        return F.lit(False)
    kind = url.contains("/docs/") | (F.lit(include_resources) & url.contains("/resources/"))
    return url.startswith(root) & allowed(url, mode, root, base, True) & kind


def is_documentation(url: Column, base: str) -> Column:
    """On base's host, below base's path, and none of EXCLUDED_PATHS."""
    own = F.lit(base)
    return (host(url) == host(own)) & F.startswith(path(url), F.regexp_replace(path(own), "/+$", "")) & ~path(url).rlike("(?i)" + "|".join(EXCLUDED_PATHS))


def base_of(url: Column) -> Column:
    """What stands before `/docs/` or, without it, before `/resources/`."""
    return F.when(url.contains("/docs/"), F.substring_index(url, "/docs/", 1)).otherwise(F.substring_index(url, "/resources/", 1))


def sitemap_url(base: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit(".xml"))


def is_external_scheme(target: Column) -> Column:
    """Whether a link target is http or https; anchors, mailto and relative paths are not."""
    return target.rlike("^https?://")
