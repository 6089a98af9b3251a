"""Tags from keywords, patterns and term frequencies as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import tag

#: Categories and their keywords, in the order in which they are tried.
CATEGORIES = {
    "getting-started": ("getting started", "quick start", "overview", "introduction"),
    "administration": ("admin", "administration", "configure", "configuration", "settings", "setup"),
    "user-management": ("user", "users", "team", "teams", "member", "permission", "access", "role"),
    "api": ("api", "rest", "webhook", "integration", "developer"),
    "security": ("security", "auth", "authentication", "sso", "saml", "oauth"),
    "automation": ("automation", "automate", "workflow", "rule", "trigger"),
    "reporting": ("report", "analytics", "dashboard", "metrics", "statistics"),
    "troubleshooting": ("troubleshoot", "error", "issue", "problem", "fix"),
    "billing": ("billing", "payment", "subscription", "pricing", "plan"),
    "migration": ("migration", "import", "export", "backup", "restore"),
}
#: Technical categories and their patterns, without regard to case.
TECHNICAL = {
    "api-reference": r"/api/[^\s]+|REST API|webhook|endpoint|HTTP method|GET /|POST /|PUT /|DELETE /",
    "configuration-guide": r"\.yml|\.yaml|\.json|\.properties|configuration file|config\.|settings\.|config\.yml|config\.yaml",
    "cli-usage": r"--[a-z-]+|npm run|pip install|bash|shell command|\$\s*\w+",
    "integration-guide": r"integrate with|integration|connector|plugin|third-party|external service",
    "permissions-setup": r"permission|role|access control|admin|viewer|RBAC|authorization",
    "code-examples": r"```\w+|function\s+\w+|class\s+\w+|def\s+\w+|import\s+\w+|require\(",
    "database-guide": r"SQL|query|database|table|schema|index|migration|JOIN|SELECT|INSERT",
    "docker-guide": r"docker|container|dockerfile|docker-compose|image|volume|port\s*:\s*\d+",
    "kubernetes-guide": r"kubernetes|k8s|pod|deployment|service|ingress|kubectl|helm",
    "monitoring-guide": r"monitoring|metrics|logs|alerts|dashboard|prometheus|grafana|datadog",
}
#: Words that are no terms.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could "
    "should may might must can this that these those i you he she it we they them their what which who when where why how all "
    "each every some any many few more most other such only own same so than too very just then now also"
).split()
TERM = r"\b[a-zA-Z][a-zA-Z0-9_-]+\b"


def technical(text: Column, extra_cli: str = "") -> Column:
    """Technical categories found in a text, in the order of TECHNICAL. extra_cli: a further pattern of the command line's own name."""
    found = [F.when(text.rlike("(?i)" + p + (f"|{extra_cli}" if extra_cli and k == "cli-usage" else "")), F.lit(k)) for k, p in TECHNICAL.items()]
    return F.array_compact(F.array(*found))


def categories(text: Column) -> Column:
    """Categories with a keyword in a text, in the order of CATEGORIES."""
    found = lambda low: F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), F.lit(k)) for k, words in CATEGORIES.items())))
    # As one element of an array, the text is put in lower case once, not for each keyword.
    return F.flatten(F.transform(F.array(F.lower(text)), found))


def hierarchical(product: Column, title: Column, section: Column, crumbs: Column) -> Column:
    """The product, then categories up to three tags; with the product alone, the first inner breadcrumb of at most three words;
    below three tags, the section of at most three words."""
    none = F.array().cast("array<string>")
    start = F.when(F.coalesce(product, F.lit("")) != "", F.array(product)).otherwise(none)
    names = F.coalesce(crumbs, none)
    inner = F.when(F.size(names) > 3, F.slice(names, 3, F.greatest(F.size(names) - 3, F.lit(0)))).otherwise(none)
    words = lambda t: F.size(F.split(t, "-"))
    inner = F.slice(F.filter(F.transform(inner, tag), lambda t: (t != "") & (words(t) <= 3)), 1, 1)
    last = tag(F.coalesce(section, F.lit("")))
    first = F.array_distinct(F.concat(start, F.slice(categories(F.concat_ws(" ", title, section)), 1, 3 - F.size(start))))
    # As one element of an array, the categories are found once for a row, however often they are used.
    with_inner = lambda r: F.when(F.size(r) <= 1, F.array_distinct(F.concat(r, inner))).otherwise(r)
    with_last = lambda r: F.when((F.size(r) < 3) & (last != "") & (words(last) <= 3), F.array_distinct(F.concat(r, F.array(last)))).otherwise(r)
    return F.flatten(F.transform(F.transform(F.array(first), with_inner), with_last))


def terms(text: Column) -> Column:
    """Lower-cased terms of a text in order: longer than three letters and no stop words."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def final(tags: Column, found: Column, most: int = 10) -> Column:
    """Tags with found ones appended, without repetition, `most` at most."""
    return F.slice(F.array_distinct(F.concat(tags, found)), 1, most)
