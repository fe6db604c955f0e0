"""Web pages to records by tag patterns; tags and classes are parameters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import rules
from leadspark.functions.columns import absolute_url, contains_any, or_blank


def page_text(html: Column | str) -> Column:
    """Text of a fragment: tags dropped, the five named entities and white space resolved."""
    text = F.regexp_replace(or_blank(html), r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_scripts(html: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(or_blank(html), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")


#: Fixed facts of the markup: elements without content, and those whose end tag may be left out with how deep they stand in their
#: container; such an element ends where another of its depth or a lower one starts.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OPTIONAL = {"tr": 1, "td": 2, "th": 2, "li": 2, "dt": 2, "dd": 2, "option": 2, "p": 3}
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b([^>]*)>")


@dataclass
class Element:
    tag: str
    attrs: str
    begin: int
    end: int
    up: int | None
    depth: int


def parse(html: str) -> list[Element]:
    """Elements of a page in order, with the stretch between their tags and the element around them.

    An end tag closes the latest open element of its name and all that opened after it; one that closes nothing is left out. What is
    open at the end of the page ends there. Linear in the tags but for elements that are open at once.
    """
    out: list[Element] = []
    stack: list[int] = []
    open_names: Counter[str] = Counter()

    def close(n: int, at: int) -> None:
        """Close the innermost ``n`` elements."""
        for i in stack[len(stack) - n :]:
            out[i].end = at
            open_names[out[i].tag] -= 1
        del stack[len(stack) - n :]

    for found in _TAG.finditer(html):
        ends, tag, attrs = found.group(1), found.group(2).lower(), found.group(3)
        if ends:
            if open_names[tag]:
                close(next(n for n, i in enumerate(reversed(stack), 1) if out[i].tag == tag), found.start())
            continue
        depth = _OPTIONAL.get(tag)
        if depth:
            n = 0
            while n < len(stack) and _OPTIONAL.get(out[stack[-1 - n]].tag, 0) >= depth:
                n += 1
            close(n, found.start())
        out.append(Element(tag, attrs, found.end(), found.end(), stack[-1] if stack else None, len(stack)))
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append(len(out) - 1)
            open_names[tag] += 1
    close(len(stack), len(html))
    return out


#: Characters of elements that a task holds before it hands them on.
PIECE = 1 << 21


def _listed(tags: frozenset[str], classes: dict[str, re.Pattern], piece: int = PIECE):
    """Arrow task over pages: listed elements, and the first element inside each that has one of the classes.

    Pages are taken out of their batch one by one, and what was found is handed on in pieces: nested elements repeat the text they share.
    """
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]

    def made(ids, source, columns):
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(source, pa.int64())), *arrays], ["page", "pos", "tag", "attrs", "inner", "up", "depth", "inside"])

    def run(batches):
        for batch in batches:
            held, source, columns = 0, [], [[] for _ in kinds]
            for row in range(batch.num_rows):
                html = batch.column(1)[row].as_py() or ""
                elements = parse(html)
                place = {i: n for n, i in enumerate(i for i, e in enumerate(elements) if e.tag in tags)}
                marked = [(i, name) for i, e in enumerate(elements) for name, p in classes.items() for value in [_CLASS.search(e.attrs)] if value and p.search(value.group(1))]
                inside: dict[int, dict[str, str]] = {}
                for i, name in marked:
                    up = elements[i].up
                    while up is not None:
                        if up in place:
                            inside.setdefault(up, {}).setdefault(name, html[elements[i].begin : elements[i].end])
                        up = elements[up].up
                for i, n in place.items():
                    e, up = elements[i], elements[i].up
                    while up is not None and up not in place:
                        up = elements[up].up
                    source.append(row)
                    for c, value in zip(columns, (n, e.tag, e.attrs, html[e.begin : e.end], place.get(up), e.depth, list(inside.get(i, {}).items())), strict=True):
                        c.append(value)
                    held += len(e.attrs) + e.end - e.begin + sum(map(len, inside.get(i, {}).values()))
                    if held >= piece:
                        yield made(batch.column(0), source, columns)
                        held, source, columns = 0, [], [[] for _ in kinds]
            yield made(batch.column(0), source, columns)
            del batch

    return run


_CLASS = re.compile(r"""(?i)\bclass\s*=\s*["']([^"']*)["']""")


def tokens(pages: DataFrame, tags: Sequence[str], page: str = "page_id", html: str = "html", classes: dict[str, str] | None = None) -> DataFrame:
    """page_id, pos, tag, attrs, inner, up, depth, inside of every listed element in page order.

    ``inner`` reaches to the element's own end tag, whatever is nested in it; an element without one ends with the element around it, a list item, cell or
    paragraph also where the next one starts. ``up`` is the pos of the listed element around it, ``depth`` the number of all elements around it, ``inside`` maps each name of
    ``classes`` (name to pattern of a class) to the first element in it of such a class. Pages are parsed one by one inside their task, without a shuffle.
    """
    body = pages.select(F.col(page).alias("page"), without_scripts(html).alias("_h"))
    schema = f"page {body.schema['page'].dataType.simpleString()}, pos int, tag string, attrs string, inner string, up int, depth int, inside map<string,string>"
    patterns = {n: re.compile(rf"(?i)\b(?:{p})\b") for n, p in (classes or {}).items()}
    return body.mapInArrow(_listed(frozenset(t.lower() for t in tags), patterns), schema).withColumnRenamed("page", page)


def attribute(attrs: Column | str, name: str) -> Column:
    return F.regexp_extract(attrs, rf"""(?i)\b{name}\s*=\s*["']?([^"'\s>]*)""", 1)


def labelled_list(pages: DataFrame, group_tag: str, item_tag: str, container: str | None = None, page: str = "page_id", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(records, pages without the container): a group heading holds for the items after it.

    An item's `<b>label:</b> value` pairs become the map ``fields`` keyed by lower-cased label.
    """
    has = F.lit(True) if container is None else F.contains(or_blank(html), F.lit(container))
    found = tokens(pages.where(has), [group_tag, item_tag, "li", "p"], page, html)
    so_far = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    group = F.last(F.when(F.col("tag") == group_tag, page_text("inner")), True).over(so_far)
    rec = F.sum(F.when(F.col("tag") == item_tag, 1).otherwise(0)).over(so_far)
    rows = found.withColumns({"group": group, "rec": rec}).where("rec > 0").where(F.col("tag") != group_tag)
    label, value = (F.regexp_extract_all("inner", F.lit(r"(?is)<b>([^<]*?):?\s*</b>\s*:?\s*([^<]*)"), F.lit(i)) for i in (1, 2))
    pairs = rows.select(page, "rec", "pos", F.explode_outer(F.arrays_zip(label.alias("k"), value.alias("v"))).alias("kv"), F.when(F.col("tag") == item_tag, page_text("inner")).alias("title"), "group")
    key = F.lower(F.rtrim(F.col("kv.k")))
    entry = F.when(F.col("kv.k").isNotNull(), F.struct("pos", key.alias("k"), F.trim("kv.v").alias("v")))
    folded = pairs.groupBy(page, "rec").agg(F.min_by("group", "pos").alias("group"), F.max("title").alias("title"), F.array_sort(F.collect_list(entry)).alias("e"))
    last = F.aggregate("e", F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return folded.select(page, "rec", "group", "title", last.alias("fields")), pages.where(~has).select(page)


def cards(pages: DataFrame, tag: str, title_tags: Sequence[str], base: str, need_link: bool = False, drop: Sequence[str] = (), nav_words: Sequence[str] = (), least: int = 5, most: int = 150, page: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, pos, title, category, date, link of every card element.

    The title is the first heading of the card, else its text; titles out of bounds (bytes), navigation
    titles and cards with a word of the drop list leave, other cards stay.
    """
    found = tokens(pages, [tag], page, html, {"category": "(?:event-)?(?:category|type)", "date": "(?:event-)?(?:date|time)"})
    heads = [F.nullif(page_text(F.regexp_extract("inner", rf"(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|$)", 1)), F.lit("")) for t in title_tags]
    by_class = lambda name: page_text(F.col("inside")[name])
    link = F.coalesce(F.nullif(attribute("attrs", "href"), F.lit("")), F.nullif(F.regexp_extract("inner", r"""(?is)<a\b[^>]*href\s*=\s*["']?([^"'\s>]*)""", 1), F.lit("")), F.lit(""))
    card = F.struct(F.coalesce(*heads, page_text("inner")).alias("title"), by_class("category").alias("category"), by_class("date").alias("date"), absolute_url(link, base).alias("link"))
    # The generator keeps the filters above it, so that the texts are made once and not again in every condition.
    rows = found.select(page, "pos", F.inline(F.array(card)))
    rows = rows.where(F.octet_length("title").between(least, most)).where(~((F.lower("title") == "events") | contains_any("title", nav_words)))
    rows = rows.where(~(contains_any("title", drop) | contains_any("category", drop)))
    return rows.where("link <> ''") if need_link else rows


def headings(pages: DataFrame, tag: str, prefix: str, follow: str | None = "p", fixed: str | None = None, skip: Sequence[str] = (), page: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, pos, external_id, title, description: a heading and the paragraph after it, or a fixed text."""
    found = tokens(pages, [tag, follow] if follow else [tag], page, html)
    after = F.lead(F.struct("tag", "inner")).over(Window.partitionBy(page).orderBy("pos"))
    rows = found.withColumn("next", after).where(F.col("tag") == tag).withColumn("title", page_text("inner")).where("title <> ''")
    if skip:
        rows = rows.where(~F.col("title").isin(*skip))
    text = F.lit(fixed) if fixed is not None else F.when(F.col("next.tag") == follow, page_text("next.inner")).otherwise("")
    return rows.select(page, "pos", F.concat(F.lit(f"{prefix}:"), F.col("title")).alias("external_id"), "title", text.alias("description"))


def venue_cards(pages: DataFrame, base: str) -> DataFrame:
    return cards(pages, "a", ["h2", "h3", "h4"], base, drop=rules.VENUE_DROP, nav_words=rules.VENUE_NAV_WORDS)


def relevant(title: Column, detail: Column, positive: Sequence[str], negative: Sequence[str], whole_words: bool = False) -> Column:
    """A positive word is required and any negative one rejects; words match inside others by default."""
    text = F.concat_ws(" ", or_blank(title), or_blank(detail))
    return contains_any(text, positive, whole_words) & ~contains_any(text, negative, whole_words)
