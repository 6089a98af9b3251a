from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docspark.functions import tags
from docspark.functions import text as textf
from docspark.operators import control, extract, index, lineage, links, lint, state, tagging
from docspark.plans import flows
from docspark.sources import sitemap, store, vault
from docspark.streaming import frontier

B = "https://h/p"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_redirects(spark):
    r = spark.createDataFrame([("u/old/", "u/mid/"), ("u/mid", "u/final"), ("u/a", "u/b"), ("u/b", "u/a")], "src string, dst string")
    starts = spark.createDataFrame([("u/old/",), ("u/normal/",), ("u/a/",), (None,)], "url string")
    got = {r.url: r.final for r in links.redirect_closure(starts, r).collect()}
    assert got["u/old/"] == "u/final" and got["u/normal/"] == "u/normal/" and got["u/a/"] in ("u/a", "u/b")
    assert links.redirect_closure(starts.limit(0), r).count() == 0


def pages(spark):
    return spark.createDataFrame([(f"{B}/docs/one/", "One page", "docs/A/One page.md", 0), (f"{B}/docs/two", "Two", "docs/B/Two.md", 1), (f"{B}/resources/r", None, "resources/R.md", 2), (None, "x", None, 3)], "url string, title string, file_path string, ord long")


def test_resolve_and_convert(spark):
    docs = spark.createDataFrame([(1, "docs/A/me.md", f"[a]({B}/docs/one) [b]({B}/two/) [One page]({B}/gone) [c]({B}/new-page) [d](http://o/x) [e]({B})"), (2, "docs/A/q.md", "no links"), (3, "docs/A/z.md", None)], "doc_id long, file_path string, text string")
    got = dict(rows(links.convert(docs, pages(spark), B).select("doc_id", "text")))
    assert got[1] == "[[One page|a]] [[../B/Two|b]] [[One page|One page]] [[../../New Page|c]] [d](http://o/x) [[../../index|e]]"
    assert got[2] == "no links" and got[3] is None


def test_repair_takes_the_first_page(spark):
    t = spark.createDataFrame([("one",), ("two",), ("nothing-here",), ("a/b",)], "target string")
    assert dict(rows(links.repair(t, pages(spark)))) == {"one": "docs/A/One page", "two": "docs/B/Two"}


def test_image_references(spark):
    forms = "![Alt](https://e/i.jpg) ![](//e/i.jpg) ![x](https://e/no.jpg) ![[https://e/i.jpg|a]] <img src=\"https://e/i.jpg\"> ![[//e/i.jpg|a]]"
    docs = spark.createDataFrame([(1, forms), (2, None), (3, "none")], "doc_id long, text string")
    images = spark.createDataFrame([("https://e/i.jpg", "images/i.jpg")], "url string, local_path string")
    got = dict(rows(links.image_references(docs, images)))
    assert got == {1: "![[images/i.jpg]] ![[images/i.jpg]] ![x](https://e/no.jpg) ![[images/i.jpg]] <img src=\"images/i.jpg\"> ![[//e/i.jpg|a]]", 2: None, 3: "none"}


def test_wikilinks_of_documents_are_repaired(spark):
    docs = spark.createDataFrame([(1, "docs/A/me.md", f"[[one|x]] [[Two|y]] [[gone| z ]] [[a/b|c]] [[alive|v]] [t]({B}/docs/two)"), (2, "docs/A/q.md", None)], "doc_id long, file_path string, text string")
    checks = spark.createDataFrame([(f"{B}/docs/alive/", f"{B}/resources/r")], "url string, final_url string")
    got = dict(rows(links.convert(docs, pages(spark), B, checks=checks).select("doc_id", "text")))
    assert got[2] is None
    assert got[1] == "[[One page|x]] [[../B/Two|y]] [[gone| z ]] [[a/b|c]] [[../../resources/R|v]] [[../B/Two|t]]"


def test_containing_finds_what_comparing_all_finds(spark):
    urls = [f"https://h/{a}-{b}" for a in ("get", "set", "x") for b in ("started", "up", "ab")]
    targets = ["get", "up", "s", "-u", "started", "none", "t-a", "https", "x-up"]
    got = rows(links.containing(spark.createDataFrame([(t,) for t in targets], "target string"), spark.createDataFrame([(u,) for u in urls], "_url string")).select("target", "_url"))
    assert got == sorted(((t, u) for t in targets for u in urls if t in u), key=repr)


def test_redirects_without_bound_and_the_latest_wins(spark):
    r = spark.createDataFrame([(f"u/{k}", f"u/{k + 1}", 0) for k in range(60)] + [("u/60", "u/z", 1), ("u/60", "u/a", 2)], "src string, dst string, ord int")
    assert [(x.final, x.hops) for x in links.redirect_closure(spark.createDataFrame([("u/0",)], "url string"), r, "ord").collect()] == [("u/a", 61)]


def test_lint_vectors():
    text = '1. [[x/"|t]]\n2. [[y/"|t]]\n3. [[z/"|t]]\n4. [[x/ "some title"|t]]\n5. [[ok|t]]\n'
    fixed, found = lint.lint_text(text)
    assert sum(i[1] == "malformed_wikilink" for i in found) == 4 and '"' not in fixed and fixed.splitlines()[3] == "4. [[x|t]]"
    assert not lint.lint_text("[[resources/y|t]]\n")[1]
    one = lambda rule, t: rule(t, [])
    assert one(lint.list_empty_lines, "- a\n\ntext") == "- a\n\n\ntext" and one(lint.list_empty_lines, "- a\n\n\n- b") == "- a\n- b"
    assert one(lint.numbered_list_sequence, "3. x\n7. y\ntext\n9. z") == "1. x\n2. y\ntext\n1. z"
    assert one(lint.callout_empty_line, "> a\n\n> b") == "> a\n>\n> b" and one(lint.callout_empty_line, "> a\n\n\n> b") == "> a\n\n\n> b"
    assert one(lint.callout_empty_line, "  > a\n\n   > b\nend\n\n> c") == "  > a\n>\n   > b\nend\n\n> c"
    assert one(lint.numbered_list_sequence, "01. x\n 2.   y\n3. z") == "1. x\n2. y\n3. z"
    assert one(lint.table_missing_header, "| a | b |\n| --- | --- |") == "| a | b |\n| --- | --- |"
    assert one(lint.missing_final_newline, "") == ""


def test_lint_passes_that_settle():
    for t in ("", "a", "# h\nx\n\n\n\ny  ", "   - a\n- b\n> c\n\n> d\n5. e", "\n" * 9):
        for rule in (lint.trailing_whitespace, lint.multiple_blank_lines, lint.list_indentation, lint.missing_final_newline, lint.heading_spacing):
            once = rule(t, [])
            assert rule(once, []) == once


def test_lint_columns_agree_with_passes(spark):
    texts = ["3. a\n\n7. b\nx\n9. c", "  - a\t\n* b ", "# h\ntext\n## k", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("l", lint.lines(F.col("t")))
    for k, ns in df.select("k", lint.numbers(F.col("l"))).collect():
        lines, out, n = texts[k].split("\n"), [], 0
        for line in lines:
            item = line.strip()[:1].isdigit()
            n = n + 1 if item else n if not line.strip() else 0
            out.append(n if item else None)
        assert ns == out
    found = lint.issues(lint.lint(df.select("k", "t"), "k", "t"), "k").cache()
    told = [r.line for r in lint.report_lines(found, "k", most=1).orderBy("part", "name", "ord").collect()]
    per = {}
    for r in found.orderBy("k", "ord").collect():
        per.setdefault(r.k, []).append(r)
    every = [i for own in per.values() for i in own]
    types = sorted({i.issue_type for i in every}, key=lambda t: (-sum(i.issue_type == t for i in every), next((i.k, i.ord) for i in every if i.issue_type == t)))
    want = ["# Markdown Linting Report\n", f"Total files with issues: {len(per)}", f"Total issues found: {len(every)}\n", "## Issues by Type"]
    want += [f"- {t}: {sum(i.issue_type == t for i in every)}" for t in types] + ["\n## Files with Issues"]
    for k, own in per.items():
        want += [f"\n### {k}", f"- Line {own[0].line_number}: {own[0].description}"] + ([f"- ... and {len(own) - 1} more issues"] if len(own) > 1 else [])
    assert told == want
    assert [r.line for r in lint.report_lines(found.limit(0), "k").collect()] == ["No linting issues found!"]
    kept = lint.lint(df.select("k", "t"), "k", "t", auto_fix=False).collect()
    assert all(r.fixed == texts[r.k] for r in kept) and any(r.issues for r in kept)


def test_state(spark):
    p = spark.createDataFrame([("a", "pending", 0, None, None, None, None), ("b", "pending", 0, None, None, None, "e")], "url string, status string, retry_count int, updated_at timestamp, completed_at timestamp, file_path string, error_message string")
    e = spark.sql("select * from values ('a',1L,timestamp'2024-01-01','in_progress','',''), ('a',2L,timestamp'2024-01-02','completed','f.md',''), ('b',3L,timestamp'2024-01-03','failed','',''), ('zz',4L,timestamp'2024-01-03','failed','','') as t(url,seq,ts,status,file_path,error_message)")
    got = {r.url: r for r in state.fold(p, e).collect()}
    assert got["a"].status == "completed" and got["a"].completed_at and got["a"].file_path == "f.md" and got["b"].retry_count == 1 and got["b"].error_message == "e" and "zz" not in got
    s = state.page_statistics(state.fold(p, e)).first()
    assert (s.total, s.completed, s.failed, s.pending) == (2, 1, 1, 0)
    empty = state.page_statistics(p.limit(0)).first()
    assert empty.total == 0 and empty.completed is None
    assert state.insert_new(p, spark.createDataFrame([("a", 1), ("n", 3), ("n", 2)], "url string, ord int"), "url", "ord").collect() == [("n", 2)]


def test_controls(spark):
    assert [spark.range(1).select(control.backoff(F.lit(n), most=10.0)).first()[0] for n in (1, 2, 3, 10)] == [1, 2, 4, 10]
    events = [(1, float(t), t, ok) for t, ok in ((0, False), (1, False), (2, False), (3, True), (70, False), (140, True))]
    r = control.circuit_breaker(spark.createDataFrame(events, "key int, at double, seq int, ok boolean"), "key", 3, 60.0).first()
    assert (r["mode"], r.failures, r.refused) == ("closed", 0, 1)
    waits = control.token_bucket(spark.createDataFrame([(1, 0.0, k) for k in range(3)], "key int, at double, seq int"), "key", 2.0, 2.0).first()
    assert (waits.waits, waits.waited) == (1, 0.5)


def test_index_and_duplicates(spark):
    p = spark.createDataFrame([("u1", "B", "docs/x/B.md", "completed"), ("u2", "A", "docs/A.md", "completed"), ("u3", "G", "guide/G.md", "completed")], "url string, title string, file_path string, status string")
    text = index.index_document(p).first().text
    assert text == "# Table of Contents\n\n## docs\n- [[docs/A|A]]\n### x\n- [[docs/x/B|B]]\n\n---\nTotal documentation pages: 2\n"
    s = spark.createDataFrame([(i, "p.md", c) for i, c in enumerate(("v1", "v2", "v1", "v2", "v3"))], "i int, path string, c string")
    assert [r.stored for r in index.duplicate_names(s, "path", "c", "i").orderBy("i").collect()] == ["p.md", "p_1.md", "p.md", "p_2.md", "p_3.md"]


HTML = """<html><head><title>Late</title><script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":2,"item":{"name":"B","@id":"u2"}},{"position":1,"item":{"name":"A","@id":"u1"}}]}</script></head>
<body><nav><h3><a href="/s">Sec</a></h3><ul><li><a href="/one">One</a></li><li>x</li><li class="current"><a href="/two">Two</a></li></ul></nav>
<main><h1>Test Page</h1><p>Some <strong>bold</strong> text</p><div data-panel-type="warning"><div class="ak-editor-panel__icon">!!</div><div class="ak-editor-panel__content"><p>careful</p></div></div><div data-macro-name="details">macro</div><div data-macro-name="toc">kept</div><div class="vote">helpful?</div><link rel="stylesheet" href="x"><div><div class="see-also">also</div></div><img src="/i.png"><img src="i2.png" alt="two"><footer>foot</footer></main></body></html>"""


def test_extract(spark):
    df = spark.createDataFrame([(1, "https://h/d/two", HTML), (2, None, None), (3, "https://h/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract.pages(df).collect()}
    one = got[1]
    assert one.title == "Test Page" and "foot" not in one.content_text and "**bold**" in one.markdown and "> [!warning]" in one.markdown
    assert one.images == ["https://h/i.png", "https://h/d/i2.png"] and [b.name for b in one.breadcrumbs] == ["A", "B"]
    assert "!!" not in one.markdown and "macro" not in one.markdown and "kept" in one.markdown and "helpful" not in one.markdown and "also" in one.markdown
    assert one.page_title == "Test Page" and not one.has_more and one.page_links == [] and "foot" in one.page_text
    assert [(s.title, s.position, s.is_current) for s in one.siblings] == [("One", 0, False), ("Two", 2, True)] and one.section_heading == "Sec"
    assert got[2].title == "" and got[2].markdown == "" and got[3].images == []


def test_links_and_titles_of_live_pages(spark):
    html = '<title>T</title><nav><button data-testid="sibling-chevron-down"></button><ul><li><a href="/d/n?ref=1">n</a></li></ul></nav><main><a href="x/">1</a><a href="/d/x">2</a><a href="http://o/">3</a><a>4</a><article>a</article><div class="see-also">s</div></main><div class="related-articles">r</div>'
    got = extract.pages(spark.createDataFrame([(1, "https://h/d/", html)], "page_id long, url string, html string"))
    one = got.first()
    assert one.has_more and one.page_title == "T" and one.page_links == ["https://h/d/x/", "https://h/d/x", "http://o/"]
    assert rows(extract.documentation_links(got, "https://h/d")) == [(1, "https://h/d/n"), (1, "https://h/d/x")]


def test_related_articles_beside_the_main_content(spark):
    html = '<div id="content"><main><p>m</p><div class="see-also">in</div></main><div><div class="see-also">out</div></div></div>'
    root = __import__("docspark.functions.dom", fromlist=["dom"]).parse(html)
    extract.clean(root, "https://h/")
    assert "in" in root.text() and "out" not in root.text()


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/state")
    assert s.read("pages").count() == 0 and not s.has_any("runs")
    s.insert_new("pages", spark.createDataFrame([("a", 1), ("b", 2), ("a", 0)], "url string, ord int"), "ord")
    s.upsert("pages", spark.createDataFrame([("b", "failed", "e"), ("c", "completed", None)], "url string, status string, error_message string"))
    s.set_titles(spark.createDataFrame([("a", "A"), ("b", ""), ("z", "Z")], "url string, title string"))
    # A run that starts anew finds what was there; a change that broke off does not count.
    (tmp_path / "state" / "pages" / "v=99").mkdir()
    again = store.Store(spark, f"file://{tmp_path}/state")
    assert {(r.url, r.status, r.title) for r in again.read("pages").collect()} == {("a", "pending", "A"), ("b", "failed", None), ("c", "completed", None)}
    assert again.find("pages", "b").first().error_message == "e" and again.find("pages", "q").count() == 0 and len(again.versions("pages")) == store.KEPT
    now = F.lit("2024-01-01").cast("timestamp")
    assert again.start_run(now) == 1 and again.start_run(now) == 2
    again.finish_run(1, now)
    assert [(r.id, r.pages_total, r.pages_failed, r.completed_at is None) for r in again.read("runs").orderBy("id").collect()] == [(1, 3, 1, False), (2, None, None, True)]
    again.clear("pages")
    assert not again.has_any("pages") and again.has_any("runs")


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    """Two calls over a growing folder give what one pass over all events gives."""
    kind = "key long, at double, seq long, ok boolean"
    for turn, events in enumerate(([(1, 0.0, 0, False), (1, 1.0, 1, False), (2, 0.0, 2, True)], [(1, 2.0, 3, True), (3, 0.0, 4, False)])):
        spark.createDataFrame(events, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = frontier.breakers(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 2, 60.0)
        got = rows(frontier.run_once(stream, f"file://{tmp_path}/out", "update", f"file://{tmp_path}/check", "key"))
        assert got == ([(1, "open", 2, 0), (2, "closed", 0, 0)], [(1, "open", 2, 1), (2, "closed", 0, 0), (3, "closed", 1, 0)])[turn]


def test_tags_take_the_next_term_where_one_is_a_tag_already(spark):
    text = "alpha " * 9 + "beta_x " * 8 + "gamma " * 7 + "delta " * 6 + "once the and"
    row = spark.createDataFrame([(text,)], "t string").select(tagging.counted(tags.terms(F.col("t"))).alias("c"), tagging.top_terms(tagging.counted(tags.terms(F.col("t"))), F.array(F.lit("alpha"))).alias("top")).first()
    assert row.top == ["beta-x", "gamma"] and {(c.term, c.n, c["first"]) for c in row.c} == {("alpha", 9, 0), ("beta_x", 8, 9), ("gamma", 7, 17), ("delta", 6, 24), ("once", 1, 30)}
    assert spark.createDataFrame([("a the",), (None,)], "t string").select(tagging.counted(tags.terms(F.col("t"))).alias("c")).collect()[0].c == []


def test_titled_wikilinks(value):
    told = '[[create-a-service/ "u"|T]] [[x-y/|u]] [[a|b]] [A](https://h/p/docs/what-is-x/) [R](https://h/p/resources/r-y "t") [Q](https://h/p/q/z) [H](https://h/p) [o](http://o/) [m](mailto:x)'
    assert value(textf.titled_wikilinks(F.lit(told), B)) == "[[Create a Service|T]] [[X Y|u]] [[A|b]] [[What is X|A]] [[resources/R Y|R]] [[Q/z|Q]] [[index|H]] [o](http://o/) [m](mailto:x)"


def test_state_content(spark):
    html = '<script>window.__STATE__ = {"page":{"title":"From state","content":{"body":"<p>' + "long " * 30 + '</p>"}}};</script><p>no</p>'
    got = extract.pages(spark.createDataFrame([(1, "https://h/", html)], "page_id long, url string, html string")).first()
    assert got.title == "From state" and got.content_text.startswith("long long") and "no" not in got.content_text.split()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h/a </loc><lastmod>2024</lastmod></url><url><lastmod>x</lastmod></url></urlset>')
    assert sitemap.read_sitemaps(spark, str(tmp_path / "m.xml")).collect() == [("https://h/a", "2024")]
    out = spark.createDataFrame([("docs/a.md", "one"), ("../evil.md", "two"), ("b.md", "three")], "path string, text string")
    assert rows(vault.write_files(out, f"file://{tmp_path}/v")) == [("b.md", 5), ("docs/a.md", 3)]
    assert sorted(r.text for r in sitemap.read_markdown(spark, f"{tmp_path}/v").collect()) == ["one", "three"]
    assert sitemap.read_images(spark, f"{tmp_path}/v").count() == 2
    front = spark.range(1).select(vault.frontmatter([("url", F.lit("https://h")), ("n", F.lit("a: 'b'")), ("none", F.lit(""))], [("tags", F.array(F.lit("x")))])).first()[0]
    import yaml

    assert yaml.safe_load(front.strip("-")) == {"url": "https://h", "n": "a: 'b'", "tags": ["x"]}


def test_shared_folder_without_setting():
    of = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert lineage.shared_folder(of("local[2]")) == lineage.shared_folder(of("local[8]"))
    with pytest.raises(ValueError, match="share"):
        lineage.shared_folder(of("spark://h:1"))


def test_spread_keeps_rows_and_leaves_many_partitions(spark):
    few, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, 64)
    assert rows(lineage.spread(few)) == rows(few) and lineage.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert lineage.spread(many) is many


def test_ring_and_stop(spark):
    events = spark.createDataFrame([("a", n, n % 4 != 0) for n in range(1, 13)] + [("b", 1, True), ("b", 2, False)], "k string, n long, bad boolean")
    kept = control.until_stopped(events, "k", "n", F.col("bad"), 3)
    assert rows(kept.select("k", "n")) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    ring = control.recent(events, "k", "n", 3, 2)
    assert rows(ring.select("k", "n", "age", "told")) == [("a", 10, 3, False), ("a", 11, 2, True), ("a", 12, 1, True), ("b", 1, 2, True), ("b", 2, 1, True)]


def test_health_of_no_probes(spark):
    none = spark.createDataFrame([], "disk_free_gb double, disk_used int, memory_free_gb double, memory_used int, cpu_used int")
    assert rows(control.roll_up(control.health(none, F.lit(4)))) == [(0, None, None, 0)]
    short = spark.createDataFrame([(5.0, 10, 0.2, 10, 10)], none.schema)
    assert rows(control.health(short, F.lit(1)).select("memory_ok", "workers")) == [(False, 1)]


def test_vault_is_written_with_its_index(spark, tmp_path):
    pages = spark.createDataFrame([("docs/A/x.md", "X", "one"), ("docs/A/x.md", "X", "one"), ("docs/y.md", "Y", "two")], "file_path string, title string, text string")
    assert rows(flows.write_vault(pages, f"file://{tmp_path}")) == [("docs/A/x.md", 3), ("docs/y.md", 3)]
    read = {r.path.rpartition(str(tmp_path))[2]: r.text for r in sitemap.read_markdown(spark, f"file://{tmp_path}").collect()}
    assert read.keys() == {"/docs/A/x.md", "/docs/y.md", "/index.md"} and read["/docs/A/x.md"] == "one"
    assert "- [[docs/y|Y]]" in read["/index.md"] and not [f for f in tmp_path.rglob("*.tmp")]
