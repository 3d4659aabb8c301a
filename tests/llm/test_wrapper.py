import copy
import json
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from strandline.llm import wrapper as X

CLASHING = ", ".join(f"{c} string" for c in ("host", "template", "text", "n_chars", "salt"))


def page(title, paragraphs, n, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/{n}'>m{n}</a></li></ul></nav><!-- ad --><div class=\"ad\">buy {n}</div><article><h1>{title}</h1>{body}{extra}</article><footer>&copy; host {n}</footer></body></html>"


def extracted(spark, data):
    df = spark.createDataFrame([(*r, *("x",) * 5) for r in data], f"page_id long, url string, html string, {CLASHING}")
    return {r["page_id"]: r for r in X.extract_articles(df, X.induce_templates(df)).collect()}


def test_articles(spark):
    data = [(i, f"http://h{i % 2}.org/{i}", page(f"T&amp;{i}", [f"one\n {i}", f"two&nbsp;<b>bold</b> {i}"], i)) for i in range(12)]
    got = extracted(spark, data)
    for i in range(12):
        assert got[i]["text"] == f"T&{i}\n\none {i}\n\ntwo bold {i}" and got[i]["n_chars"] == len(got[i]["text"])


def test_constant_slot_is_template_and_copies_are_not(spark):
    data = [(i, "http://a.org/", page(f"T{i}", [f"p {i}"], i, "<div class='x'>same on every page</div>")) for i in range(20)]
    data += [(100 + i, "http://b.org/", page("same", ["same text"], i)) for i in range(20)]
    data += [(200, "http://c.org/", page("only", ["one page"], 0, "<div class='x'>same on every page</div>"))]
    got = extracted(spark, data)
    assert got[3]["text"] == "T3\n\np 3"
    assert got[105]["text"] == "same\n\nsame text"
    assert got[200]["text"] == "only\n\none page\n\nsame on every page"


def test_copies_among_other_pages_are_one_page(spark):
    listed = "<ul><li>one</li><li>two</li></ul><blockquote>said</blockquote>"
    data = [(i, "http://a.org/", page("copy", ["text"], i, listed)) for i in range(30)]
    data += [(100 + i, "http://a.org/", page(f"T{i}", [f"p {i}"], i)) for i in range(20)]
    # The slot below is on eight different pages.
    data += [(200 + i, "http://a.org/", page(f"U{i}", [f"q {i}"], i, "<div class='x'>same</div>")) for i in range(8)]
    got = extracted(spark, data)
    assert all(got[i]["text"] == "copy\n\ntext\n\none\n\ntwo\n\nsaid" for i in range(30))
    assert got[103]["text"] == "T3\n\np 3" and got[203]["text"] == "U3\n\nq 3"


def test_notices_forms_and_comments():
    html = "<body><header>h</header><main><p>a</p><form>f</form><aside>s</aside><div class='cookie-notice'>c</div><section id='comments'><p>r</p></section><p hidden>x</p><p>b<br>c</p></main><div role='complementary'>z</div>"
    assert X.extract(html, None) == "a\n\nb c"


def test_odd_markup():
    assert X.extract(None, None) == X.extract("", None) == X.extract("   ", None) == ""
    assert X.extract("no markup &lt;here&gt; &amp &am", None) == "no markup <here> & &am"
    assert X.extract("<p>a<p>b<ul><li>c<li>d</ul>e", None) == "a\n\nb\n\nc\n\nd\n\ne"
    assert X.extract("<article><h1>t</h1><p><b>x<br><p>y", None) == "t\n\nx\n\ny"
    assert X.extract("<div a=\"un<p>closed</div>", None) in ("closed", "un closed", "")
    assert X.extract("<p>a < b</p><!-- open", None) == "a < b"
    assert X.extract("<p>" + "<div>" * 3000 + "deep", None) != "x"


def test_odd_rows(spark):
    data = [(1, None, None), (2, "", ""), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (None, "http://q/", "<p>y</p>"), (4, "http://q/", "<p>" + "long " * 50_000 + "</p>")]
    got = extracted(spark, data)
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "x" and got[None]["text"] == "y" and got[4]["n_chars"] == 249_999
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert X.extract_articles(empty, X.induce_templates(empty)).count() == 0


def letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_every_layout_of_a_host_is_read(spark):
    # More layouts than a partial template holds; the last ones show that the notice is on every page and the slot beside it is not.
    data = [(i, None, f"<body class='{letters(i)}'>" + "".join(f"<div class='{letters(k)}'>" for k in range(9)) + f"<p>p {i}</p>") for i in range(1000)]
    data += [(5000 + i, None, f"<body class='late'><p>always</p><div class='{'x' if i < 8 else 'y'}'>t {i // 8}</div><section>{i}</section>") for i in range(16)]
    got = extracted(spark, data)
    assert all(got[i]["text"] == f"p {i}" for i in range(1000))
    assert [got[5000 + i]["text"] for i in (0, 15)] == ["0", "15"]


def test_a_full_task_hands_its_forms_on(monkeypatch):
    pages = [f"<body class='{letters(i)}'>" + "".join(f"<div class='{letters(k)}'>" for k in range(9)) + "<p>p</p>" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([None] * 300, pa.string()), pa.array(pages)], names=["url", "html"])
    monkeypatch.setattr(X, "OPEN_NODES", 1000)
    parts = list(X._forms([batch]))
    assert len(parts) > 3 and sum(sum(b.column(3).to_pylist()) for b in parts) == 300 * len(X.GRAINS)


def test_blocks_the_template_does_not_know():
    root, found = X.parse("<body class='a'><p>x")
    X.filled(root)
    form, places = X.slots(root, 0)
    wrapper = X.Wrapper(X.grown(form, X.numbers(places, found, X.page_mark(found))), 0)
    assert X.extract("<body class='b'><nav>n</nav><p>y", wrapper) == "y"


def bare(i, notice=True):
    """No article element and no telling class: a menu of links, a notice, a story, a list of links that differ."""
    menu = "".join(f"<span><a href='/{k}'>go {k}</a></span> " for k in range(4))
    said = "<div><p>We keep this text on every page of the site.</p></div>" if notice else ""
    return f"<body><div>{menu}</div>{said}<div><h2>Story {i}</h2><p>It was number {i}.</p><p>And {i * 7} more.</p></div><div><em><a href='/x{i}'>see page {i + 1}</a></em></div></body>"


def test_the_template_tells_content_where_no_name_does(spark):
    got = extracted(spark, [(i, "http://bare.org/", bare(i)) for i in range(20)])
    assert all(got[i]["text"] == f"Story {i}\n\nIt was number {i}.\n\nAnd {i * 7} more." for i in range(20))
    # One page alone cannot tell the notice.
    assert X.extract(bare(3)).startswith("We keep")


def test_hints_yield_to_the_bulk_of_the_text(spark):
    # The whole page is a form, as some sites have it, and the story's class is a mark.
    data = [(i, "http://f.org/", f"<body><p>Same line everywhere</p><form><div class='widget'><p>{'long story ' * 20}{i}</p></div></form>") for i in range(12)]
    got = extracted(spark, data)
    assert got[5]["text"] == f"{'long story ' * 20}5"


def test_names_in_an_article():
    assert X.extract("<article><header><h1>Title</h1></header><p class='alert'>Body</p><div class='social-history'>was</div><div class='share-buttons'>tweet</div><footer>by</footer></article>") == "Title\n\nBody\n\nwas"


def test_late_pages_of_many_classes(spark):
    data = [(i, "http://a.org/", f"<body><article><h1>t {i}</h1><div class='{letters(i)}'><p>only {i}</p></div></article>") for i in range(1200)]
    data.append((5000, "http://a.org/", "<article><h1>late</h1><div class='zz'><p>unique zzzz</p></div></article>"))
    got = extracted(spark, data)
    assert got[5000]["text"] == "late\n\nunique zzzz" and got[1199]["text"] == "t 1199\n\nonly 1199"


def test_a_host_of_more_forms_than_are_kept(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_FORMS", 20)
    data = [(i, "http://a.org/", f"<body class='{letters(i)}'><div><p>always the same</p></div><div><p>only {i}</p><ul><li>x</li></ul></div>") for i in range(60)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    t = X.induce_templates(df)
    import json

    assert [json.loads(r["template"])[0] for r in t.collect()] == [1]
    got = {r["page_id"]: r["text"] for r in X.extract_articles(df, t).collect()}
    assert got[7] == "only 7" and len(got) == 60


def random_page(rng):
    kinds = ["<p>%s</p>", "<div><p>%s</p></div>", "<ul><li>%s</li></ul>", "<div><h2>k</h2>%s</div>", "<section>%s</section>"]
    return "<body>" + "".join(rng.choice(kinds) % rng.choice(["same", f"w{rng.random()}"]) for _ in range(rng.randint(1, 6)))


def test_no_order_of_pages_or_parts_matters():
    rng = random.Random(7)
    pages = [random_page(rng) for _ in range(60)]

    def template(order, cuts):
        order = [pages[i] for i in order]
        rows = []
        for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
            batch = pa.RecordBatch.from_arrays([pa.array([None] * (b - a), pa.string()), pa.array(order[a:b], pa.string())], names=["url", "html"])
            rows += [r for out in X._forms([batch]) for r in out.to_pylist()]
        rng.shuffle(rows)
        # Equal forms meet, in whatever order they come.
        rows.sort(key=lambda r: (r["host"], r["grain"], r["form"]))
        added = [r for out in X._added([pa.RecordBatch.from_pylist(rows)]) for r in out.to_pylist() if r["grain"] == 0]
        rng.shuffle(added)
        return [out.to_pylist() for out in X._folded([pa.RecordBatch.from_pylist(added)])]

    first = template(range(60), [])
    for _ in range(15):
        assert template(rng.sample(range(60), 60), sorted(rng.sample(range(1, 60), 3))) == first


def test_join_path_is_the_same(spark):
    data = [(i, f"http://h{i % 3}.org/{i}", page(f"T{i}", [f"p {i}"] * (i % 4), i)) for i in range(30)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    t = X.induce_templates(df)
    a = sorted(map(str, X.extract_articles(df, t).collect()))
    old, X.BROADCAST_BYTES = X.BROADCAST_BYTES, 0
    try:
        assert sorted(map(str, X.extract_articles(df, t).collect())) == a
    finally:
        X.BROADCAST_BYTES = old


def random_tree(rng, depth=0):
    n = [rng.choice("abc"), [], [1, 0, [], 1, 0]]
    if depth < 3:
        n[1] = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return n


def brute(a, b):
    if a[0] != b[0]:
        return 0

    def forests(x, y):
        if not x or not y:
            return 0
        return max(forests(x[1:], y), forests(x, y[1:]), brute(x[0], y[0]) + forests(x[1:], y[1:]))

    return 1 + forests(a[1], b[1])


def test_tree_matching_is_largest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = random_tree(rng), random_tree(rng)
        a[0] = b[0] = "r"
        assert X.match(a, b, {}) == brute(a, b)


def size(n):
    return 1 + sum(map(size, n[1]))


def test_merge_keeps_every_page_alignable():
    rng = random.Random(4)
    t = ["r", [], [0, 0, [], 0, 0]]
    pages = []
    for _ in range(30):
        p = random_tree(rng)
        p[0] = "r"
        pages.append(p)
        X.merge(t, copy.deepcopy(p))
    for p in pages:
        assert X.match(t, p, {}) == size(p) == brute(t, p)


def test_wide_pages_have_small_trees_and_whole_texts():
    import time

    parts = [f"<div class='k{letters(i)}'><p>t{i}</p></div>" if i % 2 else f"<section><ul><li>u{i}</li></ul><p>v{i}</p></section>" for i in range(20_000)]
    page = "<body><article>" + "".join(parts) + "</article>"
    began = time.process_time()
    root, found = X.parse(page)
    X.filled(root)
    form, places = X.slots(root, 0)
    assert size(form) < 3 * X.MANY and sorted(i for p in places for i in p) == list(range(len(found)))
    assert X.extract(page).split("\n\n") == [t for i in range(20_000) for t in ([f"t{i}"] if i % 2 else [f"u{i}", f"v{i}"])]
    assert time.process_time() - began < 20
    few = "<body>" + "".join(f"<div class='c{letters(i % 40)}'>x{i}</div>" for i in range(200))
    root, _ = X.parse(few)
    X.filled(root)
    assert size(X.slots(root, 0)[0]) == 3


def folded(rows):
    """Texts of (id, url, html) by the templates of their hosts, without Spark."""
    forms = {}
    for _, url, html in rows:
        root, found = X.parse(html)
        if found:
            X.filled(root)
            form, places = X.slots(root, 0)
            key, fresh = (X.host_of(url), json.dumps(form)), X.numbers(places, found, X.page_mark(found))
            if key in forms:
                forms[key][0] += 1
                for a, b in zip(forms[key][1], fresh, strict=True):
                    X.add(a, b)
            else:
                forms[key] = [1, fresh]
    hosts = {h: X.Wrapper(X.fold([(n, f, g) for (x, f), (n, g) in forms.items() if x == h]), 0) for h, _ in forms}
    return {i: X.extract(html, hosts.get(X.host_of(url))) for i, url, html in rows}


def test_given_pages_without_any_name(monkeypatch):
    """With no mark and every telling element a plain one, alignment and mass alone find the same articles."""
    pages = [(r["page_id"], r["url"], r["html"] or "") for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    named = folded(pages)
    monkeypatch.setattr(X, "MARKS", frozenset())
    monkeypatch.setattr(X, "ASIDE_TAGS", frozenset())
    plain = [(i, u, re.sub(r"<(/?)(article|main|nav|footer|header|aside)\b", r"<\1div", h, flags=re.I)) for i, u, h in pages]
    same = sum(text == named[i] for i, text in folded(plain).items())
    assert same >= 0.95 * len(pages) and sum(map(bool, named.values())) > 0.9 * len(pages)


def neutral(i):
    text = f"<h1>Title {i}</h1><p>{f'words of text {i}. ' * 4}</p><p>{f'More {i} text. ' * 3}</p>"
    return f"<body><div class=k><a href=1>Home {i}</a> <a href=2>News {i * 7}</a></div><div class=o>Offer number {i} buy now</div><div class=t>{text}</div><div class=z>Page {i} of the site, copyright</div></body>"


def test_neutral_names_with_varying_adverts_and_footers(spark):
    got = extracted(spark, [(i, f"http://n.org/{i}", neutral(i)) for i in range(40)])
    for i in range(40):
        assert got[i]["text"] == f"Title {i}\n\n{(f'words of text {i}. ' * 4).strip()}\n\n{(f'More {i} text. ' * 3).strip()}"


def test_a_name_does_not_outweigh_the_text():
    social = lambda i: f"<body><div class=menu><a href=1>a</a></div><div class='social'><p>The social history of the town {i} {'in the year of ' * 20}</p></div><div class=ad>Buy {i}</div></body>"
    for n in (12, 1):
        for text in folded([(i, "http://s.org/", social(i)) for i in range(n)]).values():
            assert text.startswith("The social history") and "Buy" not in text


def test_parts_that_are_not_thin_stay():
    two = lambda i: f"<body><div class=a><p>{f'first {i} ' * 20}</p></div><div class=b><p>{f'second {i} ' * 12}</p></div><div class=c>line {i}</div></body>"
    got = folded([(i, "http://t.org/", two(i)) for i in range(12)])
    assert all(f"first {i}" in got[i] and f"second {i}" in got[i] for i in range(12))
    titled = lambda i: f"<body><h1>Title {i}</h1><div class=b><p>{f'text {i} ' * 40}</p></div></body>"
    assert folded([(i, "http://u.org/", titled(i)) for i in range(12)])[4].startswith("Title 4\n\n")


def shaped(i, rng):
    """A page of a layout that few others have: classes tell the notice from the story, and sections vary in number and kind."""
    inner = "".join(rng.choice(["<div class='part'><p>%s</p></div>", "<section><h2>%s</h2></section>", "<ul><li>%s</li></ul>", "<blockquote>%s</blockquote>"]) % f"piece {i} {k}" for k in range(rng.randint(1, 9)))
    return f"<body class='post-{letters(i)}'><div class='note'><p>Said on every page</p></div><div class='story'><h1>Story {i}</h1>{inner}</div><div class='{'odd' if i % 2 else 'even'}'>Known {i % 2}</div></body>"


def test_the_number_of_forms_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, f"http://h{i % 7 // 6}.org/", shaped(i, rng)) for i in range(400)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")

    def read():
        t = X.induce_templates(df)
        return sorted(map(tuple, t.collect())), {r["page_id"]: r["text"] for r in X.extract_articles(df, t).collect()}

    whole = read()
    monkeypatch.setattr(X, "MAX_FORMS", 3)
    assert read() == whole
    for i in range(400):
        assert whole[1][i].split("\n\n") == [f"Story {i}", *re.findall(r"piece \d+ \d+", data[i][2])]


def test_names_of_single_pages_do_not_tell(spark):
    data = [(i, "http://a.org/", f"<body class='page {letters(i)}'><div><p>always the same</p></div><div><p>only {i}</p><ul><li>x</li></ul></div>") for i in range(60)]
    assert all(r["text"] == f"only {i}" for i, r in extracted(spark, data).items())
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert [r["text"] for r in X.telling_words(df).collect()] == ['["page"]']
