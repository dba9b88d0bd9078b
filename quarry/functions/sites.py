"""Publications as data: where a site keeps an article's body, what is noise in it, and what its URLs and maps mean."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .web import _BLOCKS, _NOISE, _VOID, _name, host, json_ld, parse_page, path_parts, tidy, url_part


@dataclass(frozen=True)
class Mark:
    """What tells an element: its tag, id, the id's beginning, classes it has all of, one it lacks, a part of the class
    attribute; ``inside`` tells an element around it."""

    tag: str = ""
    id: str = ""
    id_begins: str = ""
    classes: tuple[str, ...] = ()
    lacks: str = ""
    part: str = ""
    inside: Mark | None = None

    def fits(self, node: Node) -> bool:
        own, css = node.attrs.get("id", ""), node.attrs.get("class", "")
        names = css.split()
        here = (
            (not self.tag or node.tag == self.tag) and (not self.id or own == self.id) and (not self.id_begins or own.startswith(self.id_begins))
            and all(c in names for c in self.classes) and (not self.lacks or self.lacks not in names) and self.part in css
        )
        if not here or self.inside is None:
            return here
        around = node.parent
        while around is not None and not self.inside.fits(around):
            around = around.parent
        return around is not None


def css(*names: str, tag: str = "", **more) -> Mark:
    return Mark(tag=tag, classes=names, **more)


class Node:
    """An element of a page."""

    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []


class _Tree(HTMLParser):
    """A page as nodes; end tags without a start are ignored, others close what is open inside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while True:
                closed, self.at = self.at.tag, self.at.parent
                self.open[closed] -= 1
                if closed == tag:
                    return

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.root


def outermost(root: Node, fits) -> list[Node]:
    """Elements that fit, in the page's order, none inside another one."""
    out, queue = [], [root]
    while queue:
        node = queue.pop()
        if node.tag and fits(node):
            out.append(node)
        else:
            queue.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def text_of(root: Node, noise: tuple[Mark, ...] = ()) -> str:
    """Visible text with line breaks at blocks, without noise."""
    out: list[str] = []
    queue: list[Node | str] = [root]
    while queue:
        x = queue.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is root or not (x.tag in _NOISE or any(m.fits(x) for m in noise)):
            edge = ["\n"] if x.tag in _BLOCKS else []
            queue.extend(reversed([*edge, *x.parts, *edge]))
    return tidy("".join(out))


@dataclass(frozen=True)
class Site:
    """One publication. The first of ``bodies`` that has text is the article; its outermost matches are joined.

    ``kinds`` maps structured-data types, ``sections`` named sections and ``paths`` the path's segment ``path_at`` to
    categories, in that order of trust unless ``path_first``.
    """

    hosts: tuple[str, ...] = ()
    bodies: tuple[tuple[Mark, ...], ...] = ()
    noise: tuple[Mark, ...] = ()
    tags: Mark | None = None
    tag_meta: bool = False
    author: Mark | None = None
    author_meta: str = ""
    kinds: tuple[tuple[str, str], ...] = ()
    sections: tuple[tuple[str, str], ...] = ()
    paths: tuple[tuple[str, str], ...] = ()
    path_at: int = 0
    default: str | None = "article"
    suffixes: tuple[str, ...] = ()


_NEWS = ("NewsArticle", "news")
SITES = {
    "playground": Site(("www.playground.ru", "playground.ru"), ((css("article-content", tag="div"),),), paths=(("news", "news"), ("opinion", "review")), path_at=1, default=None),
    "stopgame": Site(("stopgame.ru", "www.stopgame.ru"), ((Mark("article", "material_content"),),), (Mark(part="_read-more"),), Mark("a", part="_tag_"), kinds=(_NEWS,), paths=(("newsdata", "news"),)),
    "ixbt_games": Site(("ixbt.games", "www.ixbt.games"), ((Mark("div", id_begins="publication-", classes=("prose",)),),), sections=(("Новости", "news"), ("Статьи", "article"), ("Обзоры", "review"))),
    "igromania": Site(("www.igromania.ru", "igromania.ru"), ((Mark("div", part="material-content_"),),), tags=Mark("a", inside=Mark("div", part="TagsOfArticle_tags")), kinds=(_NEWS, ("Review", "review"), ("Article", "article"))),
    "gamemag": Site(
        ("gamemag.ru", "www.gamemag.ru"),
        (
            (css("content-text", tag="div"),),
            (css("content-row__content", tag="div", inside=css("news-details", tag="article")),),
            (css("content-row__section", tag="div", inside=css("reviews-details", tag="article")), css("content-row__center--lg", tag="div", lacks="js-comment-section", inside=css("reviews-details", tag="article"))),
        ),
        tuple(css(c) for c in (
            "list-tags", "subscription-channel", "news-details__games", "news-details__emotion-rating", "emotion-rating", "reviews-details__score", "visual-overview",
            "news-history", "sidebar-content__inner", "social-nav", "js-comment-section", "comments",
        )),
        tag_meta=True, author=css("authors__name"), paths=(("news", "news"), ("reviews", "review")),
    ),
    "gamingonlinux": Site(("www.gamingonlinux.com", "gamingonlinux.com"), ((css("e-content", inside=css("h-entry", tag="article")),),), tags=Mark("a", inside=css("tags", "group", inside=css("h-entry", tag="article"))), kinds=(_NEWS,)),
    "pcgamer": Site(
        ("www.pcgamer.com", "pcgamer.com"),
        ((Mark("div", "article-body"),), (css("gallery-text", inside=css("gallery-image", inside=Mark(id="gallery-body"))),)),
        (*(css(c) for c in ("ad-unit", "utility-bar", "ecom-root", "inline-gallery", "inlinegallery", "youtube-video", "youtube-facade")), Mark(id="utility-bar"), Mark(part="newsletter"), Mark(part="video")),
        tag_meta=True, author_meta="mrf:authors",
    ),
    "eurogamer": Site(("www.eurogamer.net", "eurogamer.net"), ((css("article_body_content", tag="div"),),), tag_meta=True, kinds=(("Review", "review"), _NEWS), sections=(("news", "news"),)),
}


def _metas(root: Node, name: str) -> list[str]:
    found = outermost(root, lambda n: n.tag == "meta" and name in (n.attrs.get("property"), n.attrs.get("name")) and "content" in n.attrs)
    return [n.attrs["content"] for n in found]


def _unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in (tidy(x).replace("\n", " ") for x in values) if v))


def _category(site: Site, kind: str | None, section: str | None, url: str) -> str | None:
    segments = [p for p in url.split("://")[-1].partition("/")[2].split("?")[0].split("#")[0].split("/") if p]
    segment = segments[site.path_at] if len(segments) > site.path_at else None
    for table, key in ((site.kinds, kind), (site.sections, section), (site.paths, segment)):
        found = next((v for k, v in table if key is not None and k.casefold() == key.casefold()), None)
        if found:
            return found
    return site.default or section


def parse_article(html: str | None, site: Site, url: str = "") -> dict:
    """A parsed document: title, text, author, published_at, category, tags, games; ``parse_error`` says what is missing.

    A site without bodies is read by the general rules. A page that has a body with pictures only is no error.
    """
    page = html or ""
    title, _, body, author, published, section, keywords = parse_page(page)
    root = tree(page)
    scripts = outermost(root, lambda n: n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json")
    data = json_ld(["".join(p for p in s.parts if isinstance(p, str)) for s in scripts])
    kinds = [next((t for t in (d.get("@type") if isinstance(d.get("@type"), list) else [d.get("@type")]) if isinstance(t, str)), None) for d in data]
    article = next((d for d, k in zip(data, kinds) if k in ("NewsArticle", "Article", "Review", "ReportageNewsArticle", "BlogPosting")), {})
    kind = next((k for d, k in zip(data, kinds) if d is article), None)
    first = lambda name: next(iter(_metas(root, name)), None)
    heads = [t for t in (text_of(h) for h in outermost(root, lambda n: n.tag == "h1")) if t]
    media = False
    if site.bodies:
        body = ""
        for marks in site.bodies:
            found = outermost(root, lambda n: any(m.fits(n) for m in marks))
            body = "\n\n".join(dict.fromkeys(t for t in (text_of(n, site.noise) for n in found) if t))
            media = media or any(outermost(n, lambda x: x.tag in ("img", "video", "iframe", "embed", "object")) for n in found)
            if body:
                break
    title = (heads[0] if heads else None) or (article.get("headline") if isinstance(article.get("headline"), str) else None) or first("og:title") or title
    for s in site.suffixes:
        title = title.removesuffix(s).rstrip() if title else title
    names = [text_of(n) for n in outermost(root, site.author.fits)] if site.author else []
    author = (names or [None])[0] or (first(site.author_meta) if site.author_meta else None) or author or first("article:author:username")
    labels = [text_of(n).lstrip("# ") for n in outermost(root, site.tags.fits)] if site.tags else []
    section = section or first("article:section")
    about = article.get("about")
    games = [_name(x) for x in (about if isinstance(about, list) else [about])]
    if site.bodies:
        error = None if body or (media and title) else "no body" if title else "no title and no text"
    else:
        error = None if title or body else "no title and no text"
    return {
        "title": title, "text": body, "author": author, "published_at": published or first("article:published_time"), "category": _category(site, kind, section, url),
        "tags": _unique([*keywords, *(_metas(root, "article:tag") if site.tag_meta else []), *labels]), "games": _unique([g for g in games if g]), "parse_error": error,
    }


PARSED = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in ("title", "text", "author", "published_at", "category")), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "games")), T.StructField("parse_error", T.StringType())]
)


def parse_articles(source: Column, html: Column, sites: dict[str, Site] = SITES, url: Column | None = None) -> Column:
    """Parsed documents of pages from several sources; unknown sources use the general rules."""

    @F.pandas_udf(PARSED)
    def parse(sources: pd.Series, pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = [parse_article(p, sites.get(s, Site()), u or "") for s, p, u in zip(sources, pages, urls)]
        return pd.DataFrame(rows, columns=PARSED.names)

    return parse(source, html, F.lit("") if url is None else url)


# What URLs say. Each listing rule is (source, segments from the first on, most segments or 0); a segment may be one of several.

_GUIDES = ("action", "adventure", "city-builder", "fps", "guides", "mmo", "news", "puzzle", "quizzes", "reviews", "roguelike", "rpg", "strategy", "survival-crafting")
LISTINGS = (
    ("stopgame", ("games", "compilation"), 0), ("eurogamer", ("authors",), 0), ("eurogamer", ("games",), 2), ("gamingonlinux", ("articles", "category"), 0),
    *(("pcgamer", (s,), 0) for s in ("author", "tag", "archive")), ("pcgamer", ("news", "archive"), 0),
    *(("pcgamer", s, len(s)) for s in (("news",), ("games",), ("games", _GUIDES), ("gaming-industry",), ("hardware",), ("software",), ("hardware", "controllers", "game-pads"), ("software", "platforms"), ("games", "rpg", "dragon-age"))),
)
#: (source, pattern of the map's path, category); a null pattern takes every map on the site's hosts.
MAPS = (
    ("playground", "/sitemap/news/list\\.xml$", "news"), ("playground", "/sitemap/opinion/list\\.xml$", "review"),
    *(("stopgame", f"^/sitemap/{k}_", v) for k, v in (("news", "news"), ("blogs", "blog"), ("reviews", "review"), ("articles", "article"), ("compilations", "article"))),
    ("ixbt_games", "/export/sitemap-[0-9]+\\.xml$", "publication"), *(("igromania", f"/sitemap-{k}\\.xml$", v) for k, v in (("news", "news"), ("articles", "article"), ("reviews", "review"))),
    *((s, None, "publication") for s in ("pcgamer", "eurogamer", "gamemag", "gamingonlinux")), ("siliconera", "/(?:post|article)-sitemap[0-9]*\\.xml$", "publication"),
)
#: Sources whose documents are classed by their path's first segment; others keep their map's category.
PATHS = {
    "gamemag": (("news", "news"), ("reviews", "review"), ("articles", "article"), ("specials", "article")),
    "ixbt_games": (("news", "news"), ("articles", "article"), ("reviews", "review")),
}
_PAGED = ("pcgamer",)


def listing_url(source: Column, url: Column) -> Column:
    """Is it one of the page shapes of that source that are known to be lists, or its front page?"""
    parts = F.transform(path_parts(url), F.lower)
    n = F.size(parts)
    paged = source.isin(*_PAGED) & (n >= 3) & (F.get(parts, n - 2) == "page") & F.get(parts, n - 1).rlike("^[0-9]+$")
    short = F.when(paged, F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(parts)
    out = (n == 0) & source.isin(*SITES) & (url_part(url, 2) != "")
    for name, segments, most in LISTINGS:
        fits = (source == name) & (F.size(short) <= most if most else F.lit(True))
        for i, s in enumerate(segments):
            fits &= F.coalesce(F.get(short, F.lit(i)).isin(*([s] if isinstance(s, str) else s)), F.lit(False))
        out |= fits
    return F.coalesce(out, F.lit(False))


def sitemap_category(source: Column, url: Column) -> Column:
    """Category of a child map's documents; null for maps of services."""
    path, at = F.lower(url_part(url, 3)), host(url)
    out = F.lit(None).cast("string")
    for name, pattern, category in reversed(MAPS):
        fits = at.isin(*SITES[name].hosts) if pattern is None else path.rlike(pattern)
        out = F.when((source == name) & fits, category).otherwise(out)
    return out


def document_category(source: Column, url: Column, from_map: Column) -> Column:
    """Category of a document's URL: null for lists and for what the site's paths don't class."""
    first = F.lower(F.get(path_parts(url), F.lit(0)))
    deep = F.lower(url_part(url, 3)).rlike("^/[^/]+/")
    out = from_map
    for name, table in PATHS.items():
        by_path = F.lit(None).cast("string")
        for segment, category in table:
            by_path = F.when((first == segment) & deep, category).otherwise(by_path)
        out = F.when(source == name, by_path).otherwise(out)
    return F.when(~listing_url(source, url), out)
