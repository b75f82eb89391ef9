"""Main texts of made pages, and simple tree matching against its plain recursion."""

import random

import pytest

from sessionlog.llm import domtree, wrapper

SCHEMA = "page_id long, url string, html string, host string, text string, slots int, reference string"


def said(rng, n):
    return " ".join(rng.choice(["one", "two", "naïve", "日本", "a&b", "x<y", "end."]) + str(rng.randrange(999)) for _ in range(n))


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


def page(rng, kind, i):
    """(html, main text) of a page in one of several layouts."""
    blocks = [said(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6))]
    body = "".join(f"<p>{escaped(b)}" + ("</p>" if rng.random() < 0.5 else "\n ") for b in blocks)
    menu = "".join(f"<li><a href=/{w}>{w}</a>" for w in ("home", "news", f"m{i}"))
    if kind == "article":
        html = (f"<head><title>{blocks[0]}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav>"
                f"<header>Site</header><div class='ad box'>buy {i}</div><article><header><h1>Title {i}</h1></header>{body}"
                f"<form><p>mail</p></form><section id=comments><p>reader {i} says</p></section></article>"
                f"<aside><p>aside {i}</p></aside><footer>&copy; {i}</footer>")
        return html, "\n".join([f"Title {i}", *blocks])
    if kind == "main":
        return f"<div role=banner>x</div><main><h1>T &lt; {i}</h1>{body}</main><script>if (a</script>", "\n".join([f"T < {i}", *blocks])
    # No mark at all: only the alignment with other pages tells what is constant.
    html = (f"<body><div><p>Welcome to our site, which has always the same long greeting for you</p></div>"
            f"<div><div><h2>Story {i}</h2>{body}</div></div><div><p>Call us now, the same offer stands on every page</p>"
            f"<ul>{menu}</ul></div>")
    return html, "\n".join([f"Story {i}", *blocks])


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        kind = ["article", "main", "plain"][i % 3]
        html, text = page(rng, kind, i)
        rows.append((i, f"http://user@{kind}.Example.com:80/{i}?q", html, text))
    rows += [(100 + i, rows[0][1], rows[0][2], rows[0][3]) for i in range(30)]  # copies on one host
    rows += [(200, None, "<p>no url</p>", "no url"), (201, "not a url", "<p>a<br>b&nbsp; c", "a b c"), (202, "http://x.org/", None, ""),
             (203, "http://x.org/", "", ""), (204, "http://x.org/", "  \n ", ""), (None, "http://y.org/", "plain &amp; bare", "plain & bare"),
             (205, "http://z.org", "<article>" + "<p>long text</p>" * 5000, "\n".join(["long text"] * 5000)),
             (206, "http://z.org", "<div>" * 3000 + "deep", "deep"), (207, "http://z.org", "<p>cut <b", "cut"),
             (207, "http://z.org", "<p>cut <b", "cut")]
    return rows


def found(spark, rows):
    df = spark.createDataFrame([(p, u, h, "h", "t", 4, "r") for p, u, h, *_ in rows], SCHEMA)
    got = wrapper.main_texts(df.repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_layouts(spark, made):
    assert found(spark, made) == sorted(((p, u, t, len(t)) for p, u, _, t in made), key=str)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_template_is_what_most_pages_have(spark, made):
    """Without other pages of the host the greeting cannot be told from the story."""
    alone = found(spark, [r for r in made if r[0] == 2])
    assert "Story 2" in alone[0][2]
    many = dict((r[0], r[2]) for r in found(spark, made))
    assert "Welcome" not in many[2] and "Call us" not in many[2]


def plain_score(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, p in enumerate(a.kids):
        for j, q in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_score(p, q))
    return 1 + best[-1][-1]


def grown(rng, depth):
    n = domtree.Node(rng.choice("abc") if depth < 4 else "r")
    if depth:
        n.kids = [grown(rng, depth - 1) for _ in range(rng.randrange(5))]
    return n


def test_tree_matching_is_the_largest():
    rng, m = random.Random(1), domtree.Matcher()
    for _ in range(150):
        a, b = m.ready(grown(rng, 4)), m.ready(grown(rng, 4))
        assert m.score(a, b) == plain_score(a, b) == len(m.align(a, b))


def test_matching_keeps_order_and_parents():
    rng, m = random.Random(2), domtree.Matcher()

    def parents(n, out, up=None):
        out[n.at] = up
        for k in n.kids:
            parents(k, out, n.at)
        return out

    for _ in range(50):
        a, b = m.ready(grown(rng, 4)), m.ready(grown(rng, 4))
        pairs = m.align(a, b)
        pa, pb = parents(a, {}), parents(b, {})
        assert all(x == 0 or pairs[pa[x]] == pb[y] for x, y in pairs.items())
        assert [pairs[x] for x in sorted(pairs)] == sorted(pairs.values())


@pytest.mark.parametrize("html, texts", [
    ("<p>one<p>two <b>x</b> y<br>z</p>tail", ["one", "two x y z", "tail"]),
    ("<table><tr><td>1<td>2<tr><td><p>3</table>after", ["1", "2", "3", "after"]),
    ("<article><p>x <span class='ad'>AD</span> y<div id=comments>cc</div></article><", ["x y"]),
    ("<script>if (a < b) '</p>'</script>t<!-- c --> u", ["t u"]),
    ("<article><a href='x\">y</a> q &lt;b&gt; &#233; &am</article>", ["y q <b> é &am"]),
])
def test_parsing(html, texts):
    marked, blocks, ways = wrapper.candidates(wrapper.Aligner().page(html))
    assert wrapper.without_template(marked, [b.text for b in blocks], ways, [0.0] * len(blocks)) == texts


def _list_of(labels):
    return domtree.Node("ul", kids=[domtree.Node("li", kids=[domtree.Node(x) for x in parts]) for parts in labels])


def test_long_child_lists_are_matched_like_short_ones(monkeypatch):
    """Over a million pairs of children: one more in front does not shift them all."""
    same = [[f"a{i}", f"b{i}"] for i in range(1100)]
    matcher = domtree.Matcher()
    left, right = matcher.ready(_list_of([["x"], *same, ["x"]])), matcher.ready(_list_of([["y"], ["z"], *same, ["z"]]))
    found = matcher.align(left, right)
    for p, q in zip(left.kids[1:-1], right.kids[2:-1], strict=True):
        assert found[p.at] == q.at and found[p.kids[1].at] == q.kids[1].at

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([[rng.choice("abc") for _ in range(rng.randrange(4))] for _ in range(rng.randrange(12))] for _ in "ab")
        results = []
        for most in (1 << 20, 0):
            monkeypatch.setattr(domtree, "MOST_PAIRS", most)
            m = domtree.Matcher()
            results.append(m.align(m.ready(_list_of(a)), m.ready(_list_of(b))))
        assert results[0] == results[1]
