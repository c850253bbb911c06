"""Tables of web pages as rows, from a small element tree."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidewell.functions.scalars import clean_text, normalise_header

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Fixed column names of the three index tables, by header.
HEADERS = {
    "sp500": {
        "symbol": "symbol", "security": "security", "gics sector": "gics_sector", "gics sub-industry": "gics_sub_industry",
        "headquarters location": "headquarters_location", "date added": "date_added", "cik": "cik", "founded": "founded",
    },
    "ftse250": {"company": "company", "ticker": "ticker", "ftse industry classification benchmark sector": "sector"},
    "nikkei225": {"code": "code", "company name": "company_name"},
}
REQUIRED = {"sp500": ("symbol",), "ftse250": ("company", "ticker"), "nikkei225": ("code", "company_name", "industry")}


@dataclass
class Node:
    tag: str
    attributes: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def own(self, *tags: str, stop: str = "table") -> Iterator[Node]:
        """Descendants with one of ``tags``, not looking into nested ``stop`` elements."""
        for child in self.children:
            if isinstance(child, Node):
                if child.tag in tags:
                    yield child
                if child.tag != stop:
                    yield from child.own(*tags, stop=stop)

    def text(self) -> str:
        return "".join(" " if isinstance(c, Node) and c.tag == "br" else c.text() if isinstance(c, Node) else c for c in self.children)

    def has_class(self, name: str) -> bool:
        return name in (self.attributes.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.open[0]


def table_cells(page: str, table_id: str) -> tuple[list[str], list[list[str]]]:
    """Header of the first header row, and the cells of all body rows, of the table with this id."""
    table = next((n for n in tree(page).walk() if n.tag == "table" and n.attributes.get("id") == table_id), None)
    if table is None:
        return [], []
    heads = [[th.text() for th in tr.own("th")] for tr in table.own("tr")]
    header = next((h for h in heads if h), [])
    rows = [[td.text() for td in tr.own("td")] for body in table.own("tbody") for tr in body.own("tr")]
    return header, [r for r in rows if r]


def section_cells(page: str) -> tuple[dict[str, str], list[tuple[str, str, list[str], list[str]]]]:
    """Group by anchor, and (anchor, industry, header, cells) of each row of the sections' tables."""
    groups: dict[str, str] = {}
    rows: list[tuple[str, str, list[str], list[str]]] = []
    anchor = section = industry = group = ""
    for node in tree(page).walk():
        if node.tag == "div" and node.has_class("idx-componentslist-header"):
            for inner in node.walk():
                if inner.tag == "p" and inner.has_class("title"):
                    group = " ".join(inner.text().split())
                elif inner.tag == "li" and inner.has_class("list-item"):
                    for link in inner.walk():
                        href = link.attributes.get("href") or ""
                        if link.tag == "a" and href.startswith("#") and group:
                            groups[href[1:]] = group
        elif node.tag == "a" and node.attributes.get("id"):
            anchor = node.attributes["id"]
        elif node.tag == "h3" and node.has_class("idx-section-subheading"):
            industry = node.text()
            section = anchor
        elif node.tag == "table" and node.has_class("idx-extend"):
            header = [th.text() for head in node.own("thead") for th in head.own("th")]
            for body in node.own("tbody"):
                for tr in body.own("tr"):
                    cells = [td.text() for td in tr.own("td")]
                    if cells and len(cells) == len(header):
                        rows.append((section, industry, header, cells))
    return groups, rows


@udtf(returnType="row_no int, header array<string>, cells array<string>")
class HtmlTable:
    """Body rows of one table of a page, for LATERAL joins."""

    def eval(self, page: str, table_id: str) -> Iterator[tuple]:
        header, rows = table_cells(page or "", table_id)
        for i, cells in enumerate(rows):
            yield i, header, cells


@udtf(returnType="kind string, anchor string, label string, row_no int, header array<string>, cells array<string>")
class HtmlSections:
    """Anchors with their group (kind group) and section rows with their industry (kind row)."""

    def eval(self, page: str) -> Iterator[tuple]:
        groups, rows = section_cells(page or "")
        for anchor, group in groups.items():
            yield "group", anchor, group, None, None, None
        for i, (anchor, industry, header, cells) in enumerate(rows):
            yield "row", anchor, industry, i, header, cells


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_table", HtmlTable)
    spark.udtf.register("html_sections", HtmlSections)


def _records(rows: DataFrame, kind: str) -> DataFrame:
    """Columns by header name; short rows are left out, long ones cut, keys must be filled."""
    names = F.transform("header", lambda h: normalise_header(clean_text(h), HEADERS[kind]))
    cells = F.transform("cells", clean_text)
    rows = rows.where("size(cells) >= size(header)").withColumn("_m", F.map_from_entries(F.arrays_zip(names.alias("k"), F.slice(cells, 1, F.size("header")).alias("v"))))
    return rows.withColumns({name: F.col("_m")[name] for name in HEADERS[kind].values()})


def index_rows(pages: DataFrame, kind: str, html_col: str = "html") -> DataFrame:
    """Constituents of ``kind`` (sp500, ftse250, nikkei225) from pages, in page order by ``row_no``."""
    register(pages.sparkSession)
    pages = pages.withColumn("_page", F.monotonically_increasing_id())
    view = f"_tidewell_pages_{uuid.uuid4().hex}"  # callers at one time don't meet
    if kind == "nikkei225":
        pages.select("_page", F.col(html_col).alias("html")).createOrReplaceTempView(view)
        parts = pages.sparkSession.sql(f"select p._page, s.* from {view} p, lateral html_sections(p.html) s")
        groups = parts.where("kind = 'group'").select("_page", "anchor", F.col("label").alias("industry_group"))
        rows = _records(parts.where("kind = 'row'"), kind).join(groups, ["_page", "anchor"], "left")
        found = rows.withColumns({"industry_group": F.coalesce("industry_group", F.lit("")), "industry": clean_text(F.col("label")), "source": F.lit("nikkei_indexes")})
        names = [*HEADERS[kind].values(), "industry_group", "industry", "source"]
    else:
        pages.select("_page", F.col(html_col).alias("html")).createOrReplaceTempView(view)
        found = _records(pages.sparkSession.sql(f"select t.* from {view} p, lateral html_table(p.html, 'constituents') t"), kind)
        names = list(HEADERS[kind].values())
    pages.sparkSession.catalog.dropTempView(view)
    for name in REQUIRED[kind]:
        found = found.where(F.length(name) > 0)
    return found.select("row_no", *names)


def parse_index(spark: SparkSession, page: str, kind: str) -> list[dict[str, str]]:
    """Rows of one page; ValueError if it has none."""
    df = index_rows(spark.createDataFrame([(page,)], "html string"), kind).orderBy("row_no").drop("row_no")
    rows = [r.asDict() for r in df.collect()]
    if not rows:
        raise ValueError(f"Could not parse any {kind} rows.")
    return rows
