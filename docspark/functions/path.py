"""File names and paths of the vault as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.url import path as url_path

#: Words that stay in lower case within titles.
LOWER_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")
NAME_LIMIT, PATH_LIMIT = 100, 250


def capitalized(word: Column) -> Column:
    """First letter in upper case, all others in lower case."""
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(word.substr(F.lit(2), F.length(word))))


def slug_title(slug: Column) -> Column:
    """Words between hyphens as a title; LOWER_WORDS stay lower except at the very start."""
    words = F.transform(F.split(slug, "-"), lambda w, i: F.when(w == "", F.lit("")).when(F.lower(w).isin(*LOWER_WORDS) & (i > 0), F.lower(w)).otherwise(capitalized(w)))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def safe_name(text: Column) -> Column:
    """Without `<>:"|?*`, slashes as hyphens, single spaces, no dots or spaces at the ends, NAME_LIMIT characters at most."""
    name = F.regexp_replace(text, r'[<>:"|?*]', "")
    name = F.regexp_replace(F.regexp_replace(name, r"[/\\]", "-"), r"\s+", " ")
    name = F.regexp_replace(name, r"^[. ]+|[. ]+$", "")
    return F.when(F.length(name) > NAME_LIMIT, F.concat(F.left(name, F.lit(NAME_LIMIT - 3)), F.lit("..."))).otherwise(name)


def without_suffix(path: Column) -> Column:
    """`.md` goes wherever it stands."""
    return F.replace(path, F.lit(".md"), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^./]+$", "")


def relative(source: Column, target: Column) -> Column:
    """The target as a link inside the source file: its name in the same folder, else a path with `..` for each folder to leave."""
    a = F.split(without_suffix(source), "/")
    b = F.split(without_suffix(target), "/")
    folders_a, folders_b = F.slice(a, 1, F.size(a) - 1), F.slice(b, 1, F.size(b) - 1)
    reach = F.least(F.size(folders_a), F.size(folders_b))
    same = F.transform(F.sequence(F.lit(1), reach + 1), lambda i: F.when(i > reach, F.lit(False)).otherwise(F.slice(folders_a, 1, i) == F.slice(folders_b, 1, i)))
    common = F.size(F.filter(same, lambda s: s))
    ups = F.array_repeat(F.lit(".."), F.size(folders_a) - common)
    return F.array_join(F.concat(ups, F.slice(b, common + 1, F.size(b) - common)), "/")


def unquoted(text: Column) -> Column:
    """Percent-decoding that leaves `+` alone; malformed escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "/"), -1)


def file_place(url: Column, crumbs: Column, section: Column, title: Column, is_index: Column) -> Column:
    """struct(folder, name) of a page: the root by its path, folders by its breadcrumbs between the first two and the last, then
    the section; the name by its title, else by the URL's last segment.

    crumbs: array of names, may be null. Breadcrumbs called Resources or Docs make no folder.
    """
    root = F.when(url_path(url).contains("/resources"), F.lit("resources")).when(url_path(url).contains("/docs"), F.lit("docs")).otherwise(F.lit(""))
    names = F.coalesce(crumbs, F.array().cast("array<string>"))
    inner = F.when(F.size(names) > 3, F.slice(names, 3, F.greatest(F.size(names) - 3, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    inner = F.transform(F.filter(inner, lambda c: ~c.isin("Resources", "Docs")), safe_name)
    clean_section = safe_name(F.coalesce(section, F.lit("")))
    appended = (clean_section != "") & ~clean_section.eqNullSafe(F.try_element_at(inner, F.lit(-1)))
    folders = F.when(appended, F.concat(inner, F.array(clean_section))).otherwise(inner)
    slug = last_segment(url)
    clean_title = safe_name(F.coalesce(title, F.lit("")))
    name = (
        F.when(appended & F.coalesce(is_index, F.lit(False)), F.lit("index.md"))
        .when(clean_title != "", F.concat(clean_title, F.lit(".md")))
        .when(url.endswith("/"), F.lit("index.md"))
        .when(F.coalesce(slug, F.lit("")) != "", F.concat(safe_name(slug_title(unquoted(slug))), F.lit(".md")))
        .otherwise(F.lit("index.md"))
    )
    return F.struct(F.array_join(F.filter(F.concat(F.array(root), folders), lambda f: f != ""), "/").alias("folder"), name.alias("name"))


def short_path(path: Column, url: Column) -> Column:
    """Paths over PATH_LIMIT characters: the first 100 of the name, 8 digits of the URL's MD5, the extension."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.element_at(F.split(path, "/"), -1)
    short = F.concat(folder, F.left(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(100)), F.lit("_"), F.left(F.md5(url), F.lit(8)), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.when(F.length(path) > PATH_LIMIT, short).otherwise(path)


def escapes(path: Column) -> Column:
    """Whether a relative path climbs above its root at any point."""
    depth = F.transform(F.split(path, "/"), lambda p: F.when(p == "..", F.lit(-1)).when(p.isin("", "."), F.lit(0)).otherwise(F.lit(1)))
    low = F.aggregate(depth, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda s, d: F.struct((s["now"] + d).alias("now"), F.least(s["low"], s["now"] + d).alias("low")), lambda s: s["low"])
    return path.startswith("/") | (low < 0)


def image_place(image: Column, page: Column) -> Column:
    """Path of an image below a folder named after its page; images without a name get their URL's hash."""
    name = unquoted(F.element_at(F.split(url_path(image), "/"), -1))
    name = F.when(name == "", F.concat(F.lit("image_"), F.left(F.md5(image), F.lit(8)))).otherwise(name)
    name = F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(".jpg")))
    folder = F.replace(F.regexp_replace(url_path(page), "^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return F.array_join(F.filter(F.array(folder, name), lambda p: p != ""), "/")
