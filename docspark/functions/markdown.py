"""Markdown from HTML trees, with the renderer's rules: ATX headings, `-` bullets, fenced code, pipe tables."""

from __future__ import annotations

import re

from docspark.functions.dom import Node

_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
_SKIPPED = frozenset(("script", "style", "head", "noscript"))
_BLOCKS = frozenset("p div section article main ul ol table blockquote pre h1 h2 h3 h4 h5 h6 hr header footer nav aside".split())


def _inline(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def render(node: Node | str, depth: int = 0) -> str:
    """Markdown of a node; blocks are set off by blank lines. Nesting beyond 200 levels is flattened to its text."""
    if isinstance(node, str):
        return _inline(node)
    if node.tag in _SKIPPED:
        return ""
    if depth > 200:
        return _inline(node.text())
    tag = node.tag
    if tag == "pre":
        return "\n\n```\n" + node.text().strip("\n") + "\n```\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag == "table":
        return _table(node, depth)
    if tag in ("ul", "ol"):
        return "\n\n" + _list(node, depth) + "\n\n"
    inner = "".join(render(c, depth + 1) for c in node.children)
    if tag in _MARKS:
        bare = inner.strip()
        return f"{' ' * (inner[:1] == ' ')}{_MARKS[tag]}{bare}{_MARKS[tag]}{' ' * (inner[-1:] == ' ')}" if bare else ""
    if tag in ("code", "kbd", "samp"):
        return f"`{inner.strip()}`" if inner.strip() else ""
    if tag in ("sub", "sup"):
        return inner
    if tag == "a":
        href, told = node.attrs.get("href", ""), inner.strip()
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"[{told}]({href}{title})" if href and told else inner
    if re.fullmatch("h[1-6]", tag):
        told = inner.strip().replace("\n", " ")
        return f"\n\n{'#' * int(tag[1])} {told}\n\n" if told else ""
    if tag == "blockquote":
        lines = re.sub(r"\n{3,}", "\n\n", inner.strip()).split("\n")
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in lines) + "\n\n" if inner.strip() else ""
    return f"\n\n{inner.strip()}\n\n" if tag in _BLOCKS else inner


def _list(node: Node, depth: int) -> str:
    out, n = [], 0
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            n += 1
            mark = f"{n}." if node.tag == "ol" else "-"
            told = re.sub(r"\n{2,}", "\n", "".join(render(x, depth + 1) for x in c.children).strip())
            out.append(f"{mark} " + told.replace("\n", "\n" + " " * (len(mark) + 1)))
    return "\n".join(out)


def _table(node: Node, depth: int) -> str:
    rows = [[_inline("".join(render(x, depth + 1) for x in c.children)).strip().replace("|", r"\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"


def markdown(node: Node) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<!\s\s)[ \t]+\n", "\n", render(node))).strip()
