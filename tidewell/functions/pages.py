"""Web pages: whitespace, headings, sections and windows as column expressions, and a small renderer from
HTML to markdown that runs in Arrow batches."""

from __future__ import annotations

import html
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions import text as tx

# Elements that are left out, and marks of the main content.
DROPPED = {"script", "style", "noscript", "svg", "canvas", "iframe", "nav", "footer", "aside", "form", "dialog"}
CONTENT_TAGS, CONTENT_IDS = {"article", "main"}, {"content"}
CONTENT_CLASSES = {"content", "article", "post", "markdown-body", "documentation", "docs", "docMainContainer"}
CONTENT_MARKS = ["content", "article", "post", "markdown", "docs", "documentation"]
LEAST_CONTENT = 120
# Phrases and marks of pages that only a browser can show.
BROWSER_PHRASES = ["enable javascript", "javascript is required", "please enable javascript", '<meta http-equiv="refresh"']
BROWSER_MARKS = ['id="__next"', 'id="root"', 'id="app"', "data-reactroot", "window.__next_data__", "window.__apollo_state__", "__nuxt", "ng-version"]
MOST_QUIET_SCRIPTS = 8


def clean_whitespace(text: Column) -> Column:
    """Line feeds alone, lines trimmed, runs of blank lines as one, nothing blank at the ends."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?m)^[ \t\f\x0B\r]+|[ \t\f\x0B\r]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normal_text(text: Column) -> Column:
    """The common entities as signs, white space as single blanks."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def needs_browser(page: Column) -> Column:
    """A page that asks for scripts, or one of many scripts with a framework's mark."""
    low = F.lower(page)
    some = lambda parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    scripts = F.floor((F.length(low) - F.length(F.replace(low, F.lit("<script"), F.lit("")))) / len("<script"))
    return F.coalesce(some(BROWSER_PHRASES) | ((scripts >= MOST_QUIET_SCRIPTS) & some(BROWSER_MARKS)), F.lit(False))


def headings(text: Column) -> Column:
    found = F.filter(F.split(text, "\n"), lambda s: s.rlike("^#{1,6} "))
    return F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise("No headings found in the content.")


def section(text: Column, heading: str) -> Column:
    """From the first heading that contains the words, case-folded, to the next of its level or above;
    empty where there is none."""
    where = lambda lines, test: F.array_position(F.transform(lines, test), True).cast("int")

    def kept(lines: Column, start: Column, level: Column) -> Column:
        higher = where(F.slice(lines, start + 1, F.size(lines)), lambda s: s.startswith("#") & ~s.startswith(F.repeat(F.lit("#"), level + 1)))
        return F.slice(lines, start, F.coalesce(F.nullif(higher, F.lit(0)), F.size(lines)))

    def found(lines: Column, start: Column) -> Column:
        level = F.length(F.regexp_extract(F.get(lines, start - 1), "^#*", 0))
        return F.when(F.coalesce(start, F.lit(0)) == 0, "").otherwise(F.array_join(tx.bound(level, lambda n: kept(lines, start, n)), "\n"))

    return tx.bound(F.split(text, "\n"), lambda lines: tx.bound(where(lines, lambda s: s.startswith("#") & F.lower(s).contains(heading.lower())), lambda start: found(lines, start)))


def paragraph_range(text: Column, span: str) -> Column:
    """Paragraphs by number from 1: ``3``, ``1-5`` or ``10-``; empty where the range has none."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    first, dash, last = span.partition("-")
    if not first.isdigit() or int(first) < 1 or last and (not last.isdigit() or int(last) < int(first)):
        return F.lit("")
    n = (int(last) - int(first) + 1 if last else 1 << 30) if dash else 1
    return F.array_join(F.slice(parts, int(first), n), "\n\n")


def window(text: Column, start: int, most: int) -> Column:
    """``most`` characters from ``start`` on; all of them for 0."""
    return F.substring(text, start + 1, most) if most > 0 else F.substring(text, start + 1, (1 << 31) - 1 - start)


def sliced(text: Column, only_headings: bool = False, heading: str = "", span: str = "", start: int = 0, most: int = 0) -> Column:
    """Headings alone, or a section, of it a range of paragraphs, of it a window."""
    if only_headings:
        return headings(text)
    out, missing = text, F.lit(None).cast("string")
    if heading:
        found = section(out, heading)
        missing = F.when(found == "", f'Section "{heading}" not found in the content.')
        out = found
    if span:
        found = paragraph_range(out, span)
        missing = F.coalesce(missing, F.when(found == "", f'Paragraph range "{span}" is invalid or out of bounds.'))
        out = found
    return F.coalesce(missing, window(out, start, most) if start or most else out)


class Node:
    """An element of a page: its tag, attributes and children (elements and texts)."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                parts.append(at)
            elif at.tag not in DROPPED:
                todo += reversed(at.children)
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    ALONE = {"br", "hr", "img", "meta", "link", "input"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.path[-1].tag == tag:
            self.path.pop()
        node = Node(tag, {k: (v or "").strip() for k, v in attrs})
        self.path[-1].children.append(node)
        if tag not in self.ALONE:
            self.path.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag == tag:
                del self.path[i:]
                break

    def handle_data(self, data):
        self.path[-1].children.append(data)


def tree(page: str | None) -> Node:
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


def markdown(root: Node) -> str:
    """Blocks and inline marks of a page's elements; a flow element is one block of its text."""
    out: list[str] = []

    def block(s: str) -> None:
        if s.strip():
            out.append(("\n\n" if out else "") + s.strip())

    def go(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                out.extend([t + " "] if (t := " ".join(c.split())) else [])
                continue
            t, said = c.tag, c.text()
            if t in DROPPED:
                continue
            if t in ("h1", "h2", "h3", "h4", "h5", "h6"):
                block("#" * int(t[1]) + " " + said)
            elif t == "pre":
                block("```\n" + said + "\n```")
            elif t == "blockquote":
                block("> " + said if said else "")
            elif t == "li":
                block("- " + said)
            elif t == "br":
                out.append("\n")
            elif t == "hr":
                block("---")
            elif t == "img":
                block(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})" if c.attrs.get("src") else "")
            elif t == "a" and said and c.attrs.get("href"):
                out.append(f"[{said}]({c.attrs['href']}) ")
            elif t in ("code", "strong", "b", "em", "i"):
                mark = {"code": "`", "strong": "**", "b": "**"}.get(t, "*")
                out.extend([mark + said + mark + " "] if said else [])
            elif t in ("p", "div", "section", "article", "main"):
                block(said)
            else:
                go(c)

    preferred = next((n for n in root.walk() if n.tag in CONTENT_TAGS or n.attrs.get("role") == "main" or any(m in (n.attrs.get("class", "") + " " + n.attrs.get("id", "")).lower() for m in CONTENT_MARKS)), None)
    if preferred is None:
        go(root)
    else:
        holder = Node("", {})
        holder.children = [preferred]
        go(holder)
    lines = [s.strip() for s in "".join(out).split("\n")]
    return "\n".join(s for i, s in enumerate(lines) if s or i and lines[i - 1]).strip()


def main_content(root: Node) -> Node:
    """The content element of the longest text, if it is long enough; else the body, else all."""
    some = [n for n in root.walk() if n.tag in CONTENT_TAGS or n.attrs.get("role") == "main" or n.attrs.get("id") in CONTENT_IDS or CONTENT_CLASSES & set(n.attrs.get("class", "").split())]
    best = max(some, key=lambda n: len(n.text()), default=None)
    if best is not None and len(best.text()) >= LEAST_CONTENT:
        return best
    return next((n for n in root.walk() if n.tag == "body"), root)


@F.pandas_udf(StringType())
def page_markdown(pages: pd.Series) -> pd.Series:
    """Markdown of each page: of its main content, or of all of it where that is empty."""

    def one(page: str | None) -> str:
        root = tree(page)
        return markdown(main_content(root)) or main_content(root).text() or markdown(root)

    return pages.map(one)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """All entities as signs, white space as single blanks."""
    return texts.map(lambda t: " ".join(html.unescape(t or "").split()))


def result_links(page: Column) -> Column:
    """array<struct<title, url, content>> of a search page: ``article.result`` elements, else any
    ``.result``; absolute links only."""

    def one(text: str | None) -> list[dict]:
        root = tree(text)
        found = [n for n in root.walk() if "result" in n.attrs.get("class", "").split()]
        out = []
        for n in [x for x in found if x.tag == "article"] or found:
            inside = list(n.walk())
            links = [a for h in inside if h.tag == "h3" for a in h.children if isinstance(a, Node) and a.tag == "a"]
            links = links or [a for h in inside if h.tag == "h3" for a in h.walk() if a.tag == "a"] or [a for a in inside if a.tag == "a" and "href" in a.attrs]
            if links and links[0].attrs.get("href", "").startswith(("http://", "https://")):
                said = [c for c in inside if "content" in c.attrs.get("class", "").split()]
                said = [c for c in said if c.tag == "p"] or said
                out.append({"title": links[0].text(), "url": links[0].attrs["href"], "content": said[0].text() if said else ""})
        return out

    @F.pandas_udf("array<struct<title:string,url:string,content:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    return run(page)


HIT = "struct<title:string,headline:string,name:string,url:string,link:string,href:string,uri:string,description:string,snippet:string,summary:string,content:string,text:string,source:string,domain:string,engine:string,displayLink:string>"
#: Fields that hold the hits, in the order in which they are tried.
CONTAINERS = ["results", "items", "hits", "data", "web"]


def json_hits(payload: Column) -> Column:
    """array<struct<title, url, description, source>> of a JSON answer: the first container with hits, one
    level of containers inside it, or a list of hits. Of each field the first alias that is not blank
    counts; hits without an address are left out, those without a title have their address as title."""
    hits = lambda c: F.from_json(c, f"array<{HIT}>")
    at = lambda c, k: F.get_json_object(c, f"$.{k}")
    first = lambda h, *names: F.coalesce(*[F.nullif(F.trim(h[n]), F.lit("")) for n in names], F.lit(""))

    def plain(found: Column) -> Column:
        made = F.transform(found, lambda h: F.struct(first(h, "title", "headline", "name").alias("title"), first(h, "url", "link", "href", "uri").alias("url"), first(h, "description", "snippet", "summary", "content", "text").alias("description"), first(h, "source", "domain", "engine", "displayLink").alias("source")))
        kept = F.filter(made, lambda h: h["url"] != "")
        return F.transform(kept, lambda h: F.struct(F.when(h["title"] == "", h["url"]).otherwise(h["title"]).alias("title"), h["url"].alias("url"), h["description"].alias("description"), h["source"].alias("source")))

    tries = [plain(hits(payload))] + [plain(hits(at(at(payload, k), j) if j else at(payload, k))) for k in CONTAINERS for j in ("", *CONTAINERS)]
    empty = F.array().cast("array<struct<title:string,url:string,description:string,source:string>>")
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries], empty)
