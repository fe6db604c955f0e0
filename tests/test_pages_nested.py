import random

import pyarrow as pa
from pyspark.sql import functions as F

from leadspark.sources import pages

CONTAINERS, OPTIONAL, VOID = ["div", "ul", "span", "section", "a"], ["li", "p"], ["br", "img"]


def tree(rnd, depth, out, found, inside_optional=()):
    """Write a random tree; ``found`` gets (start, tag, attrs, inner) of each element as the writer knows it."""
    for _ in range(rnd.randrange(0, 4)):
        kind = rnd.random()
        if kind < 0.25 or depth == 0:
            out.append(rnd.choice(["text", " a > b ", "x&amp;y", "\n"]))
        elif kind < 0.35:
            tag = rnd.choice(VOID)
            at = sum(map(len, out))
            out.append(f"<{tag}>")
            found.append([at, tag, "", ""])
        elif kind < 0.75:
            tag, attrs = rnd.choice(CONTAINERS), rnd.choice(["", ' class="card big"', " id=x"])
            entry = [sum(map(len, out)), tag, attrs, None]
            found.append(entry)
            out.append(f"<{tag.upper() if rnd.random() < 0.3 else tag}{attrs}>")
            begin = sum(map(len, out))
            tree(rnd, depth - 1, out, found)
            entry[3] = "".join(out)[begin:]
            out.append(f"</{tag} >" if rnd.random() < 0.2 else f"</{tag}>")
        else:
            # Items in a row; the end tag of some is left out, and then the next one or the container's end ends them.
            tag = "li" if not inside_optional else "p"
            if tag in inside_optional:
                continue
            for _ in range(rnd.randrange(1, 4)):
                entry = [sum(map(len, out)), tag, "", None]
                found.append(entry)
                out.append(f"<{tag}>")
                begin = sum(map(len, out))
                tree(rnd, depth - 1, out, found, (*inside_optional, tag))
                closed = rnd.random() < 0.5
                entry[3] = "".join(out)[begin:]
                if closed:
                    out.append(f"</{tag}>")
            if not closed:
                # Only a container's end or another item may follow, so that nothing else falls into the open one.
                return


def random_page(seed):
    rnd, out, found = random.Random(seed), [], []
    while not found:
        out, found = ["<body>"], []
        tree(rnd, 5, out, found)
    return "".join([*out, "</body>"]), sorted(found)


def test_random_trees_with_void_and_unclosed_tags(spark):
    made = [(i, *random_page(i)) for i in range(300)]
    assert sum("<li>" in p and p.count("<li>") > p.count("</li>") for _, p, _ in made) > 20
    tags = [*CONTAINERS, *OPTIONAL, *VOID]
    got = pages.tokens(spark.createDataFrame([(i, p) for i, p, _ in made], "page_id int, html string"), tags)
    by_page = {}
    for r in got.collect():
        by_page.setdefault(r["page_id"], []).append((r["pos"], r["tag"], r["attrs"], r["inner"]))
    for i, _, found in made:
        assert sorted(by_page[i]) == [(n, t, a, x) for n, (_, t, a, x) in enumerate(found)]


def test_parents_and_depth():
    for seed in range(60):
        html, found = random_page(seed)
        elements = [e for e in pages.parse(html) if e.tag != "body"]
        for e in elements:
            around = [o for o in elements if o.begin < e.begin and e.end <= o.end and o is not e and o.begin <= e.begin and o.end > o.begin]
            assert e.depth >= 1 and len(around) >= e.depth - 1 - (e.begin == e.end)


def test_stray_and_missing_end_tags():
    inner = lambda html: [(e.tag, html[e.begin : e.end]) for e in pages.parse(html)]
    assert inner("</b><div>a</p><b>c</div>d</b>") == [("div", "a</p><b>c"), ("b", "c")]
    assert inner("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == [("ul", "<li>a<ul><li>b</ul>c<li>d"), ("li", "a<ul><li>b</ul>c"), ("ul", "<li>b"), ("li", "b"), ("li", "d")]
    assert inner("<table><tr><td>1<td>2<tr><td>3</table>")[1:] == [("tr", "<td>1<td>2"), ("td", "1"), ("td", "2"), ("tr", "<td>3"), ("td", "3")]
    assert inner("<div>open") == [("div", "open")] and inner("") == [] and inner("<img/>x<br>y") == [("img", ""), ("br", "")]
    assert inner("<DIV><div>x</Div></dIv>") == [("div", "<div>x</Div>"), ("div", "x")]


def test_card_in_a_card_and_nested_labels(spark):
    html = """<div class="card"><a href="/outer"><h3>Outer <i>title</i></h3></a><span class="event-category"><b>Trade</b> show</span>
      <div class="card"><h3>Inner title</h3><span class="date">May <b>1</b></span><a href="/inner">go</a></div><p class="type">late</p></div>"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, "no tags")], "page_id int, html string")
    got = pages.cards(rows, "div", ["h3"], "http://x").orderBy("pos").collect()
    assert [(r["title"], r["category"], r["date"], r["link"]) for r in got] == [("Outer title", "Trade show", "May 1", "http://x/outer"), ("Inner title", "", "May 1", "http://x/inner")]
    nested = pages.tokens(rows, ["div", "h3"]).orderBy("pos")
    assert [(r["tag"], r["up"], r["depth"]) for r in nested.collect()] == [("div", None, 0), ("h3", 0, 2), ("div", 0, 1), ("h3", 2, 2)]
    assert nested.where(F.col("page_id") > 1).count() == 0


def test_elements_are_handed_on_in_pieces():
    """Neither many pages nor elements nested in each other are held whole, and the pieces together have every element."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array([f"<div>{'x' * 50_000}</div>"] * 300 + ["<div>" * 300 + "y" * 50_000])], ["page", "html"])
    pieces = list(pages._listed(frozenset({"div"}), {})(iter([batch])))
    assert max(p.nbytes for p in pieces) < 4_000_000
    rows = [r for p in pieces for r in p.to_pylist()]
    assert [(r["page"], r["pos"]) for r in rows] == [(i, 0) for i in range(300)] + [(300, i) for i in range(300)]
    assert {r["inner"] for r in rows[:300]} == {"x" * 50_000} and [len(r["inner"]) for r in rows[300:]] == [50_000 + 5 * (299 - i) for i in range(300)]
