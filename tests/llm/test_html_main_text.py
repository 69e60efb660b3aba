import random

from quillmill.llm import html_main_text as H

from .helpers import stored

PAGES = "page_id bigint, url string, html string"


def main(page):
    return [t for t, z in H.lines_of(page) if z == H.MAIN]


def test_article_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">buy</div>
    <article><header><h1>Head &amp;amp; line</h1></header><p><b>Bold
      text<br>more</b></p><p>unclosed <i>one<p>next &lt;p&gt; a < b<aside>side</aside><ul><li>item 1<li>item 2</ul>
      <div class="share-buttons">share</div><form><input value="q"><p>ask</p></form><section id="comments"><article><p>reader</p></article></section></article>
    <footer>foot</footer><div class="cookie-notice"><p>cookies</p></div></body></html>"""
    assert main(page) == ["Head &amp; line", "Bold text more", "unclosed one", "next <p> a < b", "item 1", "item 2"]


def test_odd_pages():
    assert H.lines_of("") == [] and H.lines_of("plain") == [("plain", H.OTHER)]
    for page in ("<article><p>cut off", "<article><p title='x>y'>a</p", "</div></article><article>b</article>", "<" * 5000, "<p " + 'a="b" ' * 5000):
        H.lines_of(page)
    assert main("<article><p>cut off") == ["cut off"]
    assert main("<article>a<script>x") == ["a"]


def brute(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        found = H.shared(a, b)
        assert len(found) == brute(a, b) and found == sorted(set(found))
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)


def pages(spark, tmp_path, rows, name="pages"):
    return stored(spark, tmp_path, spark.createDataFrame(rows, PAGES), name)


def test_differencing_of_pages_without_an_article(spark, tmp_path):
    shell = "<html><body><div>Site name</div><div>Menu one</div>{}<div>All rights kept</div></body></html>"
    rows = [(i, f"https://h.example/a/{i}", shell.format(f"<p>Text number {i} is {'long ' * i}here</p>")) for i in range(10)]
    rows += [(20, "https://alone.example/x", shell.format("<p>only</p>")), (21, None, shell.format("<p>no address</p>")), (22, "https://h.example/a/9/copy", rows[9][2]), (23, "https://h.example/zz", None), (24, "https://h.example/zz", "")]
    out = {r.page_id: r.text for r in H.main_text(pages(spark, tmp_path, rows)).collect()}
    assert len(out) == len(rows)
    for i in range(9):
        assert out[i] == f"Text number {i} is {'long ' * i}here"
    assert out[20].startswith("Site name") and out[21].endswith("All rights kept") and out[23] == "" and out[24] == ""
    assert "Text number 9" in out[22]  # a copy next door deletes nothing


def test_pages_beside_copies_lose_their_template(spark, tmp_path):
    shell = "<html><body><div>Site name</div><div>Menu one</div>{}<div>All rights kept</div></body></html>"
    text = lambda i: f"<p>Text number {i} is {'long ' * 60}here</p>"
    # crawls of one page with another last line, a run of them longer than what lies on either side
    rows = [(i, f"https://h.example/b/{i:02}", shell.format(text("b") + f"<p>seen {i}</p>")) for i in range(12)]
    rows += [(30, "https://h.example/a", shell.format(text("a"))), (31, "https://h.example/c", shell.format(text("c")))]
    # short texts in a large template, and two crawls of the only page of a host
    big = f"<div>{'template ' * 80}</div>"
    rows += [(40 + i, f"https://big.example/{i}", big + f"<p>short {i}</p>") for i in range(5)]
    rows += [(50 + i, "https://two.example/x", shell.format(text("x") + f"<p>seen {i}</p>")) for i in range(2)]
    for at in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", at)
        out = {r.page_id: r.text for r in H.main_text(pages(spark, tmp_path, rows, f"copies{at}")).collect()}
        assert len(out) == len(rows)
        assert all(out[i] == f"Text number b is {'long ' * 60}here\n\nseen {i}" for i in range(12))
        assert all(out[40 + i] == f"short {i}" for i in range(5))
        assert all(out[50 + i].startswith("Site name") for i in range(2))
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_articles_keep_lines_shared_with_neighbours(spark, tmp_path):
    rows = [(i, f"https://h.example/{i}", f"<nav>m</nav><article><p>shared</p><p>own {i}</p></article>") for i in range(6)] + [(6, "https://h.example/5", "<article></article>")]
    out = {r.page_id: r.text for r in H.main_text(pages(spark, tmp_path, rows)).collect()}
    assert all(out[i] == f"shared\n\nown {i}" for i in range(6)) and out[6] == ""


def test_neighbours_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"https://{rng.choice('ab')}.example/{rng.choice(['x', 'y', 'yy'])}/{rng.randrange(40)}", "") for i in range(80)]
    table = pages(spark, tmp_path, rows).selectExpr("page_id AS rid", "url")
    got = {r.rid: r.other for r in H.neighbours(table).collect()}
    parts = {i: (u.split("/")[2], "/" + "/".join(u.split("/")[3:])) for i, u, _ in rows}
    order = sorted(parts, key=lambda i: (*parts[i], i))

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for k, i in enumerate(order):
        near = [(j, common(parts[i][1], parts[j][1])) for j in (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) if j is not None and parts[j][0] == parts[i][0]]
        assert got.get(i) == (max(near, key=lambda x: x[1])[0] if near else None)


def test_empty_table(spark, tmp_path):
    assert H.main_text(pages(spark, tmp_path, [], "none")).count() == 0


def test_cards_that_all_pages_have_are_no_article(spark, tmp_path):
    cards = "<section><article><h3>Card</h3><p>of another article</p></article><article><p>second card</p></article></section>"
    rows = [(i, f"https://h.example/{i}", f"<main><article><p>shared</p><p>own {'text ' * 30}{i}</p></article>{cards}</main>") for i in range(6)]
    rows += [(10 + i, f"https://copy.example/{i}", f"<article>the same {'text ' * 30}</article>" + cards) for i in range(2)]
    out = {r.page_id: r.text for r in H.main_text(pages(spark, tmp_path, rows, "cards")).collect()}
    assert all(out[i] == f"shared\n\nown {'text ' * 30}{i}" for i in range(6))
    assert all(out[10 + i] == f"the same {'text ' * 30}".strip() + "\n\nCard\n\nof another article\n\nsecond card" for i in range(2))  # copies tell nothing
