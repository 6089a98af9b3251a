"""Markdown and text rewriting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.path import slug_title
from docspark.functions.url import quoted


def rewrite(text: Column, pattern: str, put) -> Column:
    """text with each match m of the pattern replaced by put(m), a Column: literals and matches alternate and join again.

    The pattern must not match the empty text.
    """
    literals = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(literals, found, lambda a, m: F.array(F.coalesce(a, F.lit("")), F.when(m.isNull(), F.lit("")).otherwise(put(m))))), "")


def clean_markdown(text: Column) -> Column:
    """At most two line ends in a row, blank lines around headings and before list items, numbered items as `1.`, no blanks at line
    ends, none at the ends of the text. The steps depend on their order."""
    for pattern, new in (
        (r"\n{3,}", "\n\n"),
        (r"\n(#{1,6} )", "\n\n$1"),
        (r"(#{1,6} [^\n]+)\n(?!\n)", "$1\n\n"),
        (r"\n(- )", "\n\n$1"),
        (r"\n\d+\. ", "\n\n1. "),
        (r"(?m)[ \t]+$", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def yaml_list_gap(text: Column) -> Column:
    """`key:`, blank line, `- ` loses the blank line."""
    return F.regexp_replace(text, r"(?m)^([A-Za-z_]\w*:)\n\n-", "$1\n-")


def fix_frontmatter(text: Column) -> Column:
    """yaml_list_gap inside the leading block between two lines of `---`; texts without one stay."""
    end = F.locate("\n---\n", text, 5)
    has = text.startswith("---\n") & (end > 0)
    return F.when(has, F.concat(yaml_list_gap(text.substr(F.lit(1), end)), text.substr(end + 1, F.length(text)))).otherwise(text)


def wikilinks(text: Column, base: str) -> Column:
    """Markdown links below base become `[[path|text]]`: pages of docs by their name, of resources with that folder, others by path."""
    link = r'\[([^\]]+)\]\((' + quoted(base.rstrip("/")) + r'[^"\s)]*)(?:\s+"[^"]*")?\)'

    def put(m: Column) -> Column:
        told, url = F.regexp_extract(m, link, 1), F.regexp_extract(m, link, 2)
        rest = F.regexp_replace(F.regexp_replace(url.substr(F.lit(len(base.rstrip("/")) + 1), F.length(url)), "^/+|/+$", ""), "[?#].*$", "")
        rest = F.regexp_replace(F.regexp_replace(rest, "/+$", ""), "^docs/", "")
        return F.concat(F.lit("[["), rest, F.lit("|"), told, F.lit("]]"))

    return rewrite(text, link, put)


def titled_wikilinks(text: Column, base: str) -> Column:
    """Wikilinks whose target is a slug, perhaps with a slash and a quoted title behind it, get the slug's title as target; then links
    below base become wikilinks to their page's title: docs by name, resources in that folder, others by path, the home page as index."""
    bent = r'\[\[([^|\]]+?)/?(?:\s*"[^"|\]]*")?\|([^\]]+)\]\]'
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def mended(m: Column) -> Column:
        slug = F.regexp_replace(strip(F.regexp_extract(m, bent, 1)), '[/"]+$', "")
        return F.when(slug == "", m).otherwise(F.concat(F.lit("[["), slug_title(slug), F.lit("|"), F.regexp_extract(m, bent, 2), F.lit("]]")))

    link = r'\[([^\]]+)\]\(([^"\s)]+)(?:\s*"[^"]*")?\)'
    home = base.rstrip("/")

    def put(m: Column) -> Column:
        told, url = F.regexp_extract(m, link, 1), F.regexp_extract(m, link, 2)
        own = F.regexp_replace(url, "/+$", "")
        path = F.regexp_replace(own.substr(F.lit(len(home) + 1), F.length(own)), "^/+|/+$", "")
        name = (
            F.when(own == home, F.lit("index")).when(path.startswith("docs/"), slug_title(path.substr(F.lit(6), F.length(path))))
            .when(path.startswith("resources/"), F.concat(F.lit("resources/"), slug_title(path.substr(F.lit(11), F.length(path))))).otherwise(slug_title(path))
        )
        return F.when(url.startswith(base) & url.rlike("^https?://"), F.concat(F.lit("[["), name, F.lit("|"), told, F.lit("]]"))).otherwise(m)

    return strip(rewrite(rewrite(text, bent, mended), link, put))


def without_h1(text: Column) -> Column:
    """Without first-level headings, and with at most one blank line in a row."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(r"^#\s+"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def tag(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain(html: Column) -> Column:
    """Text of HTML without scripts, styles and comments, in single spaces; entities stay."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


def hrefs(html: Column) -> Column:
    """Targets of double-quoted href attributes outside scripts and comments, in order."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<!--.*?-->", "")
    return F.regexp_extract_all(bare, F.lit('href="([^"]*)"'), F.lit(1))


def initial_state(html: Column, variable: str, comments: bool = True) -> Column:
    """The JSON object assigned to window.<variable> in a script, as text; null if there is none. Comments go if allowed, else
    they make the value unreadable. The object ends at the first `};`."""
    tolerated = r"(?:/\*.*?\*/\s*)?" if comments else ""
    raw = F.regexp_extract(html, r"(?s)window\." + quoted(variable) + r"\s*=\s*" + tolerated + r"(\{.*?\});", 1)
    raw = F.regexp_replace(raw, r"(?s)/\*.*?\*/", "") if comments else raw
    return F.when((raw != "") & F.try_parse_json(raw).isNotNull(), raw)


def iso_stamp(at: Column) -> Column:
    """A time in the session's zone as ISO text with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def file_stamp(at: Column) -> Column:
    """A time in the session's zone as part of a file's name."""
    return F.date_format(at, "yyyy-MM-dd_HH-mm-ss")
