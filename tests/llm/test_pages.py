"""Page text: class names, open paragraphs, templates of several neighbours, and URLs that differ by query."""

from ledgerline.llm import pages


def texts(spark, rows, parts=1):
    frame = spark.createDataFrame([(k, u, h, "x") for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    found = {r.page_id: r.text for r in pages.extract_text(frame.coalesce(parts)).collect()}
    assert len(found) == len(rows)
    return [found[k] for k in range(len(rows))]


def own(page):
    return pages.main_text(pages.page_lines(page), [])


def test_unsure_names_do_not_delete_the_article():
    assert own("<div class='legal-analysis'><p>The court held so.</p><p>And so on.</p></div><div class='share-links'>Tell it</div>") == "The court held so.\n\nAnd so on."
    assert own("<h1 class='page-header'>Title</h1><p>Body of the text.</p><div class='site-header'>Home</div>") == "Title\n\nBody of the text."
    assert own("<p>Short.</p><div id='comments'>" + "<p>A long comment it is.</p>" * 9 + "</div>") == "Short."


def test_a_block_ends_an_open_paragraph():
    assert own('<div>First.</div><p class="ad">Buy now<p>Second paragraph.<p>Third.') == "First.\n\nSecond paragraph.\n\nThird."
    assert own("<div>First.<p hidden>Secret<div>Second.</div></div>Third.") == "First.\n\nSecond.\n\nThird."
    assert own('<div><p class="ad"><b>Buy</b> now</p>Text.</div>') == "Text."
    assert own('<div class="ad"><p>One<p>Two</div>Text.') == "Text."
    assert own('<p>One <span class="ad">x<p>Two</p>') == "One\n\nTwo"


def test_a_large_template_around_short_texts_goes(spark):
    frame_ = "".join(f"<div>Template line number {k} of this site</div>" for k in range(10))
    own_text = [" ".join(f"{c} word {k} of its own" for k in range(9)) for c in "xyz"]
    rows = [(f"http://h/a/{k}", f"{frame_}<div>{own_text[k]}</div>{frame_}") for k in range(3)]
    assert texts(spark, rows)[1] == own_text[1]


def test_differencing_tells_the_article_from_teasers(spark):
    teaser = "<article><h2>Read this too</h2><p>A teaser that stands on every page.</p></article>"
    own_text = [" ".join(f"{c} word {k} of its own" for k in range(9)) for c in "xyz"]
    rows = [(f"http://h/a/{k}", f"{teaser}<article><p>Shared first line.</p><p>{own_text[k]}</p></article>{teaser}<p>Aside {k}</p>") for k in range(3)]
    assert texts(spark, rows) == [f"Shared first line.\n\n{t}" for t in own_text]
    rows = [(f"http://h/a/{k}", f"{teaser}<div>{own_text[k]}</div>") for k in range(3)]
    assert texts(spark, rows) == own_text
    assert own(f"<article>One</article>{teaser}") == "One\n\nRead this too\n\nA teaser that stands on every page."


def test_copies_are_no_evidence(spark):
    body = "".join(f"<div>Line {k} of a story told twice</div>" for k in range(12))
    rows = [("http://h/a/1", body), ("http://h/b/1", body), ("http://h/c/1", body)]
    assert all(t.count("\n\n") == 11 for t in texts(spark, rows))


def test_pages_named_by_query_are_neighbours(spark):
    rows = [(f"http://h/index.php?id={k}", f"<div>Site name</div><div>Own text {k} here, longer than what stands around it</div><div>Imprint of it</div>") for k in range(4)]
    assert texts(spark, rows) == [f"Own text {k} here, longer than what stands around it" for k in range(4)]


def test_versions_of_a_path_keep_the_neighbour_before(spark):
    rows = [("http://h/a", "<div>Site name</div><div>Other one told at length</div>")]
    rows += [("http://h/b", f"<div>Site name</div><div>Version {k} of it, also at length</div>") for k in range(3)]
    assert texts(spark, rows) == ["Other one told at length", *(f"Version {k} of it, also at length" for k in range(3))]


def test_empty_pages(spark):
    assert texts(spark, [(None, None), ("http://h/a", ""), ("http://h/a", "<p"), ("", "plain &amp; text")]) == ["", "", "", "plain & text"]
    assert pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
