"""Lint of Markdown: fourteen passes in a fixed order, each on what the one before made, with issues by line.

lint() runs all passes on whole documents in one Arrow function. The rules that look at single lines or neighbours also exist as
Column expressions over arrays of lines; those stay in the JVM and suit a single rule over a large corpus.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.batches import map_texts, parts

ISSUE = "array<struct<line_number:int,issue_type:string,description:string,original:string,fixed:string>>"
_ISSUE = pa.list_(pa.struct([("line_number", pa.int32()), ("issue_type", pa.string()), ("description", pa.string()), ("original", pa.string()), ("fixed", pa.string())]))
#: HTML that has a Markdown form.
INLINE_HTML = ((r"<br\s*/?>", "  \n"), (r"<strong>(.*?)</strong>", r"**\1**"), (r"<b>(.*?)</b>", r"**\1**"), (r"<em>(.*?)</em>", r"*\1*"), (r"<i>(.*?)</i>", r"*\1*"), (r"<code>(.*?)</code>", r"`\1`"))
ITEM, NUMBERED, BULLET = r"^([-*+]|\d+\.)\s+", r"^(\d+)\.\s+(.*)$", r"^(\s+)([-*+])\s+(.*)$"
HEADING, ROW, RULE = r"^#{1,6}\s+", r"^\s*\|[^|]+\|[^|]+\|", r"^\s*\|[\s\-:]+\|\s*$"

Issue = tuple[int, str, str, str, str | None]


def _short(text: str, most: int = 50) -> str:
    return text[:most] + "..." if len(text) > most else text


def content_before_h1(text: str, out: list[Issue]) -> str:
    lines = text.split("\n")
    at = next((i for i, line in enumerate(lines) if re.match(r"^#\s+", line)), None)
    if at is None or at == 0:
        return text
    front = 0
    if lines[0].strip() == "---":
        front = next((i + 1 for i in range(1, at) if lines[i].strip() == "---"), 0)
    loose = [line for line in lines[:at] if line.strip() and not line.startswith("---") and not re.fullmatch(r"\s*\[\[[^\]]*\]\]\s*", line)]
    if not loose:
        return text
    out.append((1, "content_before_h1", "content before the first heading", _short("\n".join(lines[:at])), None))
    return "\n".join([*lines[:front], *([""] if front else []), *lines[at:]])


def multiline_wiki_link(text: str, out: list[Issue]) -> str:
    def put(m: re.Match) -> str:
        target, told = m[1], m[2]
        if "\n" not in m[0]:
            return m[0]
        parts = [p.strip() for p in told.split("\n")]
        joined = " ".join(p for p in parts if p and not p.startswith("View topic")) or target.strip()
        fixed = f"[[{' '.join(target.split())}|{joined}]]"
        out.append((text.count("\n", 0, m.start()) + 1, "multiline_wiki_link", "link over several lines", _short(m[0]), _short(fixed)))
        return fixed

    return re.sub(r"\[\[([^|\]]+)\|([^\]]*)\]\]", put, text)


def malformed_wikilink(text: str, out: list[Issue]) -> str:
    def put(m: re.Match) -> str:
        fixed = f"[[{m[1].strip()}|{m[2]}]]"
        if fixed == m[0]:
            return m[0]
        out.append((text.count("\n", 0, m.start()) + 1, "malformed_wikilink", "slash or quotes in a link", m[0], fixed))
        return fixed

    return re.sub(r"\[\[([^|\]\"\n]+?)/?\s*(?:\"[^\"\n]*\"?)?\|([^\]\n]+)\]\]", put, text)


def internal_link_format(text: str, out: list[Issue]) -> str:
    lines = text.split("\n")
    for i, line in enumerate(lines):
        for m in re.finditer(r"\[([^\]]+)\]\(([^)]+)\)", line):
            if not re.match("https?://", m[2]):
                target = m[2].rsplit("/", 1)[-1][:-3] if m[2].endswith(".md") else m[2]
                fixed = f"[[{target}|{m[1]}]]"
                lines[i] = lines[i].replace(m[0], fixed)
                out.append((i + 1, "internal_link_format", "internal link in Markdown form", m[0], fixed))
    return "\n".join(lines)


def table_missing_header(text: str, out: list[Issue]) -> str:
    lines, made = text.split("\n"), []
    for i, line in enumerate(lines):
        starts = re.match(ROW, line) and (i == 0 or not re.match(ROW, lines[i - 1]))
        if starts and i + 1 < len(lines) and re.match(RULE, lines[i + 1]):
            cells = line.strip().strip("|").count("|") + 1
            made += ["|" + "  |" * cells, "|" + " --- |" * cells]
            out.append((i + 1, "table_missing_header", "table without a header", line, None))
        made.append(line)
    return "\n".join(made)


def heading_spacing(text: str, out: list[Issue]) -> str:
    lines, made = text.split("\n"), []
    for i, line in enumerate(lines):
        heading = bool(re.match(HEADING, line))
        if heading and i > 0 and lines[i - 1].strip():
            made.append("")
            out.append((i + 1, "heading_spacing", "no blank line before a heading", line, None))
        made.append(line)
        if heading and i + 1 < len(lines) and lines[i + 1].strip():
            made.append("")
            out.append((i + 1, "heading_spacing", "no blank line after a heading", line, None))
    return "\n".join(made)


def trailing_whitespace(text: str, out: list[Issue]) -> str:
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if (bare := line.rstrip()) != line:
            out.append((i + 1, "trailing_whitespace", "white space at the end of a line", repr(line), repr(bare)))
            lines[i] = bare
    return "\n".join(lines)


def multiple_blank_lines(text: str, out: list[Issue]) -> str:
    fixed = re.sub(r"\n{3,}", "\n\n", text)
    if fixed != text:
        out.append((0, "multiple_blank_lines", "several blank lines in a row", "", None))
    return fixed


def inline_html(text: str, out: list[Issue]) -> str:
    for pattern, new in INLINE_HTML:
        fixed = re.sub(pattern, new, text)
        if fixed != text:
            out.append((0, "inline_html", "HTML that has a Markdown form", pattern, new))
            text = fixed
    return text


def callout_empty_line(text: str, out: list[Issue]) -> str:
    """Single blank lines between lines that start with `>`, indented ones too; each callout is told once."""
    lines, inside, told = text.split("\n"), False, False
    quoted = [line.strip().startswith(">") for line in lines]
    for i, line in enumerate(lines):
        if quoted[i]:
            told, inside = told and inside, True
        elif inside and not line.strip() and i + 1 < len(lines) and quoted[i + 1]:
            if not told:
                out.append((i + 1, "callout_empty_line", "blank line inside a callout", "", ">"))
            lines[i], told = ">", True
        else:
            inside = False
    return "\n".join(lines)


def list_indentation(text: str, out: list[Issue]) -> str:
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(BULLET, line):
            lines[i] = f"{m[2]} {m[3]}"
            out.append((i + 1, "list_indentation", "indented list item", line, lines[i]))
    return "\n".join(lines)


def list_empty_lines(text: str, out: list[Issue]) -> str:
    """Blank lines between items go. Where blanks lead to something else, they are written twice, as the rule's loop does."""
    lines, made, i = text.split("\n"), [], 0
    while i < len(lines):
        made.append(lines[i])
        if re.match(ITEM, lines[i].strip()):
            j = i + 1
            while j < len(lines) and not lines[j].strip():
                j += 1
            blanks = lines[i + 1 : j]
            if blanks and j < len(lines) and re.match(ITEM, lines[j].strip()):
                out.append((i + 2, "list_empty_lines", "blank lines between list items", "", None))
                i = j
                continue
            made += blanks
        i += 1
    return "\n".join(made)


def numbered_list_sequence(text: str, out: list[Issue]) -> str:
    lines, n = text.split("\n"), 0
    for i, line in enumerate(lines):
        if m := re.match(NUMBERED, line.strip()):
            n += 1
            fixed = f"{n}. {m[2]}"
            if line.strip() != fixed:
                out.append((i + 1, "numbered_list_sequence", "number out of sequence", line.strip(), fixed))
                lines[i] = fixed
        elif line.strip():
            n = 0
    return "\n".join(lines)


def missing_final_newline(text: str, out: list[Issue]) -> str:
    if not text or text.endswith("\n"):
        return text
    out.append((text.count("\n") + 1, "missing_final_newline", "no line end at the end", "", None))
    return text + "\n"


PASSES = (
    content_before_h1, multiline_wiki_link, malformed_wikilink, internal_link_format, table_missing_header, heading_spacing, trailing_whitespace,
    multiple_blank_lines, inline_html, callout_empty_line, list_indentation, list_empty_lines, numbered_list_sequence, missing_final_newline,
)


def lint_text(text: str | None, passes=PASSES) -> tuple[str, list[Issue]]:
    found: list[Issue] = []
    text = text or ""
    for rule in passes:
        text = rule(text, found)
    return text, found


def _lint_batches(key: str, passes, auto_fix: bool):
    names = [key, "fixed", "changed", "issues"]

    def run(batches):
        for part in parts(batches, "_text"):
            fixed, issues, changed = [], [], []
            for t in part.column("_text").to_pylist():
                new, found = lint_text(t, passes)
                new = new if auto_fix else t or ""
                fixed.append(new)
                changed.append(new != (t or ""))
                issues.append([dict(zip(("line_number", "issue_type", "description", "original", "fixed"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fixed, pa.string()), pa.array(changed, pa.bool_()), pa.array(issues, _ISSUE)], names)

    return run


def lint(docs: DataFrame, key: str, text: str = "text", passes=PASSES, auto_fix: bool = True) -> DataFrame:
    """docs -> key, fixed, changed, issues. Null counts as empty text. Without auto_fix the texts stay and issues are only told."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    return map_texts(rows, _lint_batches(key, passes, auto_fix), f"{key} {kind}, fixed string, changed boolean, issues {ISSUE}")


def issues(linted: DataFrame, key: str) -> DataFrame:
    """One row for each issue, with its place in the document's list."""
    return linted.select(key, F.posexplode("issues").alias("ord", "i")).select(key, "ord", "i.*")


def counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """issue_type, n, rank: issues of each type, the commonest first, of equals the one that comes first by document and place."""
    each = found.groupBy("issue_type").agg(F.count("*").alias("n"), F.min(F.struct(key, "ord")).alias("first"))
    # As many rows as there are rules.
    return each.select("issue_type", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first", "issue_type")).alias("rank"))


def totals(found: DataFrame, key: str) -> DataFrame:
    """One row: documents with issues, and issues."""
    return found.agg(F.countDistinct(key).alias("files"), F.count("*").alias("issues"))


def report_lines(found: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The report as (part, name, ord, line), to be written in this order: totals, types by count, then documents by name with their
    first `most` issues. Without issues the only line says so."""
    line = lambda part, name, ord_, text: (F.lit(part).alias("part"), name.alias("name"), ord_.cast("long").alias("ord"), text.alias("line"))
    all_ = totals(found, key)
    none = F.col("issues") == 0
    head = F.when(none, F.array(F.lit("No linting issues found!"))).otherwise(F.array(
        F.lit("# Markdown Linting Report\n"), F.concat(F.lit("Total files with issues: "), F.col("files").cast("string")), F.concat(F.lit("Total issues found: "), F.col("issues").cast("string"), F.lit("\n")), F.lit("## Issues by Type"),
    ))
    top = all_.select(F.posexplode(head).alias("p", "l")).select(*line(0, F.lit(""), F.col("p"), F.col("l")))
    types = counts(found, key).select(*line(1, F.lit(""), F.col("rank"), F.concat(F.lit("- "), "issue_type", F.lit(": "), F.col("n").cast("string"))))
    title = all_.where("issues > 0").select(*line(2, F.lit(""), F.lit(0), F.lit("\n## Files with Issues")))
    files = found.groupBy(key).agg(F.count("*").alias("n"))
    name = F.col(key).cast("string")
    heads = files.select(*line(3, name, F.lit(-1), F.concat(F.lit("\n### "), name)))
    own = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("rank") <= most)
    told = own.select(*line(3, name, F.col("rank"), F.concat(F.lit("- Line "), F.col("line_number").cast("string"), F.lit(": "), "description")))
    more = files.where(F.col("n") > most).select(*line(3, name, F.lit(most + 1), F.concat(F.lit("- ... and "), (F.col("n") - most).cast("string"), F.lit(" more issues"))))
    return top.union(types).union(title).union(heads).union(told).union(more)


def write_report(found: DataFrame, key: str, path: str, most: int = 5) -> None:
    """Writes the report as text, in order, over as many files as the sort has parts."""
    report_lines(found, key, most).orderBy("part", "name", "ord").select("line").write.text(path)


def report(found: DataFrame, key: str, most: int = 5) -> DataFrame:
    """For each document its first issues, how many there are, and how many are left out. A bounded heap for each document does
    this without a sort of all its issues."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("ord")))
    return ranked.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "line_number", "issue_type")))), lambda s: F.concat(F.lit("Line "), s["line_number"].cast("string"), F.lit(": "), s["issue_type"])), "\n").alias("told"),
        F.count("*").alias("n"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"),
    )


# ---- rules over arrays of lines ----


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_issues(rows: DataFrame, key: str, lines: str, fixed) -> DataFrame:
    """Lines that fixed(line) changes: key, line_number, original, fixed."""
    return rows.select(key, F.posexplode(lines).alias("i", "original")).select(key, (F.col("i") + 1).alias("line_number"), "original", fixed(F.col("original")).alias("fixed")).where("original <> fixed")


def without_trailing(line: Column) -> Column:
    return F.regexp_replace(line, r"[ \t\r\f\x0B]+$", "")


def at_column_zero(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t]+([-*+])[ \t]+(.*)$", "$1 $2")


def without_html(line: Column) -> Column:
    for pattern, new in INLINE_HTML:
        line = F.regexp_replace(line, pattern, new.replace("\\1", "$1"))
    return line


def neighbours(lines: Column) -> Column:
    """array of (i, line, before, after), with nulls beyond the ends."""
    return F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), x.alias("line"), F.get(lines, i - 1).alias("before"), F.get(lines, i + 1).alias("after")))


def numbers(lines: Column) -> Column:
    """For each line its number within the list, null for other lines; other lines that are not blank start anew."""
    item = lambda x: F.trim(x).rlike(r"^\d+\.\s+")
    step = lambda s, x: F.struct(
        F.when(item(x), s["n"] + 1).when(F.trim(x) == "", s["n"]).otherwise(F.lit(0)).alias("n"),
        F.concat(s["all"], F.array(F.when(item(x), s["n"] + 1))).alias("all"),
    )
    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all")), step, lambda s: s["all"])
