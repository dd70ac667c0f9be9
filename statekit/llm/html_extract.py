"""Main text of web pages by consensus of the pages of a host.

Each page scores its containers (text without links, less for links) and votes for the generalised tag-class path
of the best one: the innermost beside which there is no text but links and less than a paragraph. Spark adds the votes per host and keeps the paths that lead there. Then every page is extracted
again from the first winning path that it has; a page with none uses its own best container.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form script style textarea title noscript iframe xmp head template button select option svg canvas object dialog menu label input".split())
CONTAINER = frozenset("article main section div td body".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section main div body html aside nav form".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer hidden masthead menu modal nav navbar navigation newsletter "
    "notice overlay pagination pager popup promo promoted promotion related respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu".split())
DEEP = 12  # levels of a path, from below
PATHS = 3  # winning paths per host
SHARE = 0.1  # of a host's votes that a path needs
SHORT = 70  # characters of a page, links and headings aside, that are less than a paragraph
LINKS = 0.5  # share of a block from which it is links


class Page:
    """One pass over a page: blocks of text in order, each with the containers around it."""

    def __init__(self, source: str):
        self.paths: list[str | None] = [None]  # of every container; the first is the page, which has a path only if it is the best
        self.parents: list[int] = [-1]
        self.scores: list[float] = [0.0]
        self.plain: list[float] = [0]  # characters of the own blocks that are not links; endless with a heading
        self.whole: list[bool] = [False]  # article or main
        self.blocks: list[tuple[int, str]] = []  # innermost container and text, in order
        self._read(source)
        self.best = self._best()
        if self.best == 0 and self.blocks:
            self.paths[0] = ""

    def _read(self, source: str) -> None:
        stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]  # tag, path, container, dropped
        text: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined and not stack[-1][3]:
                box = stack[-1][2]
                self.blocks.append((box, joined))
                self.scores[box] += len(joined) - 3 * min(links, len(joined))
                if links < LINKS * len(joined):
                    heading = any(s[0] in HEADING for s in stack[1:])
                    self.plain[box] += float("inf") if heading else len(joined)
            links = 0

        def pop(to: int) -> None:
            if any(s[0] not in INLINE for s in stack[to:]):
                flush()
            del stack[to:]

        at = 0
        while at < len(source):
            m = TOKEN.match(source, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0][0] != "<" or m[0] == "<":
                    if not stack[-1][3]:
                        text.append(m[0])
                        if any(s[0] == "a" for s in stack[-4:]):
                            links += len(m[0])
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if tag in INLINE and stack[k][0] not in INLINE or stack[k][0] in SCOPE and tag not in SCOPE:
                        break
                continue
            if tag in ("br", "hr") and not stack[-1][3]:
                text.append(" ")
            if tag in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1) if tag in CLOSES_P or tag in CLOSES else ():  # end tags that may be left out
                if stack[k][0] == "p" and tag in CLOSES_P or stack[k][0] in CLOSES.get(tag, ()):
                    pop(k)
                    break
                if stack[k][0] in SCOPE:
                    break
            if tag not in INLINE:
                flush()
            above = stack[-1]
            attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3] else {}
            names = re.sub("[0-9]+", "#", attributes.get("class", "")).split()
            dropped = above[3] or tag in DROPPED or self._noise(tag, names, attributes, above)
            path, box = above[1], above[2]
            if tag not in INLINE:
                path = ">".join([*path.split(">")[1 - DEEP :], ".".join([tag, *sorted(names)])])
            if tag in CONTAINER and not dropped:
                box = len(self.paths)
                self.paths.append(path)
                self.parents.append(above[2])
                self.whole.append(tag in ("article", "main"))
                self.scores.append(200.0 if self.whole[-1] else 0.0)
                self.plain.append(0)
            if m[3] and m[3].endswith("/") and tag not in INLINE | CONTAINER:
                continue
            if tag in RAW_END:
                end = RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
                dropped = True
            stack.append((tag, path, box, dropped))
        flush()

    @staticmethod
    def _noise(tag: str, names: list[str], attributes: dict, above: tuple) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        if tag == "header" and ">article" not in above[1] and ">main" not in above[1]:
            return True
        if attributes.get("role", "").lower() in ROLES or attributes.get("aria-hidden") == "true" or "hidden" in attributes:
            return True
        words = {w for n in [*names, attributes.get("id", "")] for w in re.split("[-_#]+", n.lower())}
        return bool(words & NOISE)

    def _best(self) -> int:
        """From the page down to the container that holds most, as long as nothing beside it is text of the page."""
        total, plain = list(self.scores), list(self.plain)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += max(0.0, total[k])
            plain[self.parents[k]] += plain[k]
        inner: dict[int, list[int]] = {}
        for k in range(1, len(total)):
            inner.setdefault(self.parents[k], []).append(k)
        k, beside = 0, 0
        while k in inner and not self.whole[k]:
            down = max(inner[k], key=lambda j: total[j])
            beside += self.plain[k] + sum(plain[j] for j in inner[k] if j != down)
            if total[down] <= 0 or beside >= SHORT:
                break
            k = down
        return k

    def text(self, paths: list[str]) -> str:
        """Blocks below all containers of the first path that the page has."""
        for path in paths:
            roots = {k for k, p in enumerate(self.paths) if p == path}
            if roots:
                break
        else:
            roots = {self.best}
        inside = [k in roots for k in range(len(self.paths))]
        for k in range(len(inside)):
            inside[k] = inside[k] or (k > 0 and inside[self.parents[k]])
        return " ".join(t for box, t in self.blocks if inside[box])


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, path (that it was taken from by vote, or null).

    Null or empty html gives an empty text; a page without any container gives all its text. Its path, and that of a
    page of which no part is enough, is empty. A null url counts
    as the empty host, which votes like others. Ties between paths go to the first by name. Repeated rows stay
    repeated; other columns are ignored.
    """
    types = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))

    def vote(batches):
        for batch in batches:
            hosts, paths = [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source)
                if page.blocks:
                    hosts.append(host)
                    paths.append(page.paths[page.best])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    total = votes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("host")))
    ranked = total.where(F.col("share") >= SHARE).withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path")))
    winners = ranked.where(F.col("k") <= PATHS).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))

    def again(batches):
        for batch in batches:
            texts, used = [], []
            for source, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                page = Page(source)
                texts.append(page.text(paths or []))
                used.append(next((p for p in paths or [] if p in page.paths), None))
            out = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars", "path"])

    known = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return known.mapInArrow(again, f"page_id {types['page_id']}, url string, text string, n_chars long, path string")
