"""Main text of web pages by template deduction from equivalence classes.

Pages are read into containers (elements that structure a page, with their class and id) and blocks of text. Over all
pages of a host, tokens - containers and fixed texts at their container - that occur equally often in each page share
an occurrence vector; the vectors are aggregated as a page count and the xor of hashes of (page, count), so no host is
ever in one task. Tokens with one vector form an equivalence class; classes that are large and frequent enough and whose
tokens' parents are in such classes too nest into the host's template. What the template repeats (fixed texts, link
lists) goes, inside article containers too; its remaining slots are the page's text, without containers whose element,
role, class or id marks them as navigation, advert, form, comment and the like. Marks of the article are added evidence:
texts in an article need more support to go, and on a page with an article, blocks outside it stay only in slots of the
template. Hosts without a template have the marks alone.

Whole pages are read, twice: for tokens and for text; nulls count as empty. Pages without "://" in their url share one host. Repeated rows are each
extracted, as are those with null ids; pages of one content count once for the template. An empty table gives an empty
result. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import hold, join_hot, ship
from tableproof.llm.url_filter import host_of

ship(__name__)

#: Elements whose content is no text, that break blocks, that hold other content, that are never closed.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title"}
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = set("html head body article main section div nav header footer aside form ul ol dl table figure dialog menu fieldset details td".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of classes and ids that mark what is not the article.
BAD_ELEMENTS = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "button", "select", "option", "label", "fieldset"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
BAD_WORDS = set("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations share sharing social footer masthead topbar toolbar comment comments commentlist replies reply respond disqus pagination pager skip".split())
ARTICLE_WORDS = {"articlebody"}
#: Names that tell what a container has beside or in it ("has-comments", "layout-with-sidebar"), not what it is.
ABOUT = re.compile(r"(?<![a-z])(?:has|have|with|without|no|show|hide|is)[-_]+[a-z0-9]+")

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^<>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass(frozen=True)
class TemplateSpec:
    #: A host with fewer pages has no template; tokens of a class stand on so large a share of the host's pages.
    min_pages: int = 5
    support: float = 0.5
    #: The same for fixed texts and link lists inside an article.
    article_support: float = 0.8
    #: A class of fewer tokens is left out.
    min_tokens: int = 2
    #: A slot with so large a share of its words in links is a list of links.
    link_share: float = 0.6
    #: Hosts' templates are broadcast up to so many hosts (under 2 kB each), else joined over salted keys.
    broadcast_hosts: int = 20_000


@dataclass
class Block:
    path: str
    #: Serial number of each container on the path.
    opened: tuple[int, ...]
    bad: bool
    #: Length of the path up to the innermost article container; 0 outside.
    article: int
    words: int
    linked: int
    text: str


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in order.

    A container marked as no article takes all it holds with it, unless the article is in it: then it is the page's
    layout (a form or a "with-sidebar" around everything) and its mark counts for nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, tuple[int, ...], bool, int]] = []  # element, path, opened, hidden, article
    pieces: list[str] = []
    link, linked, at, serial = 0, 0, 0, 0
    marks: set[int] = set()  # serial numbers of marked containers
    layout: set[int] = set()  # and of those that hold an article

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        pieces.clear()
        if text:
            _, path, opened, hidden, article = stack[-1] if stack else ("", "", (), False, 0)
            words = text.count(" ") + 1
            out.append(Block(path, opened, hidden, article, words, min(linked, words), text))
        linked = 0

    while at < len(html):
        m = MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            pieces.append(text)
            if link:
                linked += len(text.split())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if name == "title":
                flush()
            close = re.compile(f"</{name}", re.I).search(html, at)
            if not (m[3] or "").rstrip().endswith("/"):
                at = close.start() if close else len(html)
            continue
        if name == "a":
            link = 0 if m[1] else 1
        elif name == "br":
            pieces.append(" ")
        if name not in BLOCKS and name not in BAD_ELEMENTS:
            continue
        flush()
        if name not in CONTAINERS and name not in BAD_ELEMENTS:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID or (m[3] or "").rstrip().endswith("/"):
            continue
        _, path, opened, hidden, article = stack[-1] if stack else ("", "", (), False, 0)
        label, marked, unseen, is_article = _marks(name, m[3] or "", article > 0)
        serial += 1
        if marked:
            marks.add(serial)
        if is_article and not (hidden or unseen):
            layout.update(opened)
        opened = (*opened, serial)
        stack.append((name, f"{path}/{label}", opened, hidden or unseen, len(opened) if is_article else article))
    flush()
    marks -= layout
    for b in out if marks else ():
        b.bad = b.bad or not marks.isdisjoint(b.opened)
    return out


def _marks(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """A container's label, whether it is marked as no article, whether hidden, whether marked as the article."""
    if not attributes.strip():
        return name, name in BAD_ELEMENTS or (name == "header" and not inside), False, name in ("article", "main")
    found: dict[str, str] = {}
    for a in ATTRIBUTE.finditer(attributes):
        found.setdefault(a[1].lower(), (a[2] or a[3] or a[4] or "").lower())
    words = set(re.split(r"[^a-z]+", ABOUT.sub(" ", f"{found.get('class', '')} {found.get('id', '')}")))
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
    named = words & BAD_WORDS or ("header" in words and not inside)
    bad = name in BAD_ELEMENTS or (name == "header" and not inside) or found.get("role") in BAD_ROLES or (bool(named) and name not in ("html", "body"))
    article = name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") in ARTICLE_WORDS
    label = name + "".join(f".{re.sub('[0-9]+', '0', c)}" for c in sorted(found.get("class", "").split())) + (f"#{re.sub('[0-9]+', '0', found['id'])}" if found.get("id") else "")
    return label, bad, hidden, article and not bad


def _mark(value: str) -> int:
    import xxhash

    n = xxhash.xxh3_64_intdigest(value)
    return n - (1 << 64) if n >= 1 << 63 else n


PAGE = _mark("\x00page")


def page_tokens(html: str | None) -> list[tuple[int, int, int, bool, bool, int, int, int]]:
    """token, path (its container), parent, whether it is a text, whether in an article, count, words, words in links.

    The first token is the page itself (PAGE); a page without text has no tokens.

    Containers are counted as often as they are opened around text. Texts marked as no article need no template to go.
    An article container is not in an article itself.
    """
    count: dict[tuple[str, str], list[int]] = {}
    seen: dict[str, set[int]] = {}
    for b in blocks(html or ""):
        parts = b.path.split("/")
        for i in range(2, len(parts) + 1):
            path = "/".join(parts[:i])
            at = count.setdefault((path, ""), [0, 0, 0, 0])
            at[0] |= 0 < b.article < i - 1
            seen.setdefault(path, set()).add(b.opened[i - 2])
            at[1] = len(seen[path])
            at[2] += b.words if i == len(parts) else 0
            at[3] += b.linked if i == len(parts) else 0
        if not b.bad:
            at = count.setdefault((b.path, b.text), [0, 0, 0, 0])
            at[0] |= b.article > 0
            at[1] += 1
    page = [(PAGE, PAGE, PAGE, True, False, 1, 0, 0)] if count else []
    return page + [(_mark(f"{path}\x00{text}"), _mark(f"{path}\x00"), _mark(path.rpartition("/")[0] + "\x00"), text != "", bool(inner), *values) for (path, text), (inner, *values) in count.items()]


def main_text(html: str | None, slots: set[int], texts: set[int], nested: set[int] = frozenset()) -> str:
    """The page's text without the host's link lists (slots) and fixed texts; nested: containers of its template."""
    found = blocks(html or "")
    article = any(b.article and not b.bad for b in found)
    kept = []
    for b in found:
        if b.bad:
            continue
        path = _mark(f"{b.path}\x00") if slots or nested else 0
        if article and not b.article and path not in nested:
            continue
        if path in slots or (texts and _mark(f"{b.path}\x00{b.text}") in texts):
            continue
        kept.append(b.text)
    return "\n".join(kept)


def tokens_of(pages: DataFrame, html_column: str, host: Column) -> DataFrame:
    """host, page (hash of its content) and the page's tokens: a row each, once for pages of one content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, p, *t) for h, p, html in zip(batch["host"], batch["page"], batch["html"], strict=True) for t in page_tokens(html)]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "path", "parent", "is_text", "inner", "n", "words", "linked"])

    html = F.col(html_column).cast("string")
    narrow = pages.select(host.alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))
    rows = narrow.mapInPandas(read, "host string, page long, token long, path long, parent long, is_text boolean, inner boolean, n long, words long, linked long")
    return rows.dropDuplicates(["host", "page", "token"])


def templates(tokens: DataFrame, spec: TemplateSpec) -> DataFrame:
    """host, slots (containers that are lists of links), texts (fixed ones) and nested (containers) of each template."""
    # vectors are summed over distinct pages, so rows that repeat a page change nothing
    vectors = tokens.groupBy("host", "token", "path", "parent", "is_text").agg(F.count(F.lit(1)).alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.sum("words").alias("words"), F.sum("linked").alias("linked"), F.bool_or("inner").alias("inner"))
    # most texts are on one page only: they go before anything is written
    repeated = hold(vectors.where(F.col("on") >= spec.support * spec.min_pages))
    pages = repeated.where((F.col("token") == PAGE) & (F.col("on") >= spec.min_pages)).select("host", F.col("on").alias("pages"))
    repeated = repeated.where(F.col("token") != PAGE)
    frequent = hold(repeated.join(pages, "host").where(F.col("on") >= spec.support * F.col("pages")))
    firm = ~F.col("inner") | (F.col("on") >= spec.article_support * F.col("pages"))
    classes = frequent.groupBy("host", "on", "vector").agg(F.count(F.lit(1)).alias("tokens")).where(F.col("tokens") >= spec.min_tokens)
    large = frequent.join(classes, ["host", "on", "vector"])
    # nesting: a token is in the template if its parent is in a class too (or it is a root)
    held = large.where(~F.col("is_text")).select("host", F.col("token").alias("parent")).distinct()
    roots = F.col("parent") == F.lit(_mark("\x00"))
    nested = large.where(~F.col("is_text") & ~roots).join(held, ["host", "parent"], "left_semi").unionByName(large.where(~F.col("is_text") & roots).select(large.columns))
    inside = large.where(F.col("is_text") & firm).join(held.withColumnRenamed("parent", "path"), ["host", "path"], "left_semi")
    # a page may open as many link lists as it likes: outside articles they need no class, inside one their parent has one
    linked = frequent.where(~F.col("is_text") & (F.col("words") > 0) & (F.col("linked") >= spec.link_share * F.col("words")))
    lists = linked.where(~F.col("inner")).select("host", "token").unionByName(linked.where(F.col("inner") & firm).join(held, ["host", "parent"], "left_semi").select("host", "token"))
    slots = lists.groupBy("host").agg(F.collect_set("token").alias("slots"))
    texts = inside.groupBy("host").agg(F.collect_set("token").alias("texts"))
    sizes = nested.groupBy("host").agg(F.collect_set("token").alias("nested"), F.count(F.lit(1)).alias("template_tokens"))
    return slots.join(texts, "host", "full").join(sizes, "host", "full").select("host", "slots", "texts", "nested", "template_tokens")


def extract(pages: DataFrame, spec: TemplateSpec = TemplateSpec(), *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, template_tokens for every row of pages."""
    host = host_of(F.col(url_column).cast("string"))
    found = hold(templates(tokens_of(pages, html_column, host), spec))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, *sets in batches:
            yield pd.Series([main_text(h, *(set(s) if s is not None else set() for s in of)) for h, *of in zip(html, *sets, strict=True)], dtype=object)

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"), host.alias("host"))
    joined = join_hot(rows, found, "host", ["page_id", "url"], spec.broadcast_hosts, how="left")
    texts = joined.select("page_id", "url", text_of("html", "slots", "texts", "nested").alias("text"), F.coalesce("template_tokens", F.lit(0)).alias("template_tokens"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_tokens")
