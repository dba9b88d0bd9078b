"""URLs, HTTP answers and HTML: native expressions where possible, Arrow-batched UDFs for parsing."""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKING = ("fbclid", "gclid", "yclid", "_ga", "_gl")
#: Words that a challenge page shows.
CHALLENGES = (
    "verify you are human", "checking your browser", "just a moment", "attention required", "access denied", "security check", "robot check",
    "подтвердите, что вы не робот", "подтвердите, что вы человек", "проверка браузера", "проверка безопасности", "доступ ограничен",
)
_PLAIN = ("captcha", "are you a robot")
_HINTS = ("captcha", "капча", "challenge", "turnstile", "ddos-guard", "are you a robot")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_replace(url_part(url, 2), r"^[^@]*@|:[0-9]*$", ""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, default path, no fragment, no tracking parameters; null for what is no URL."""
    pairs = F.filter(F.split(F.substring(url_part(url, 4), 2, 1 << 30), "&"), lambda p: ~_is_tracking(p))
    query = F.array_join(pairs, "&")
    path = F.when(url_part(url, 3) == "", "/").otherwise(url_part(url, 3))
    whole = F.concat(F.lower(url_part(url, 1)), F.lit("://"), F.lower(url_part(url, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(_URL), whole)


def _is_tracking(pair: Column) -> Column:
    name = F.lower(F.substring_index(pair, "=", 1))
    return name.startswith("utm_") | name.isin(*TRACKING) | (pair == "")


def alias_path(url: Column, prefix: str, target: str) -> Column:
    """``/prefix/<number>`` rewritten to ``/target/<number>``."""
    return F.regexp_replace(url, rf"^([a-z]+://[^/]+)/{prefix}/([0-9]+)", rf"$1/{target}/$2")


def path_parts(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(url_part(url, 3), "/"), lambda p: p != "")


def is_listing(url: Column, sections: tuple[str, ...] = ("news", "articles", "reviews", "tags", "page")) -> Column:
    """Does the URL list documents rather than being one: the root, a bare section, a tag or a page number?"""
    parts = path_parts(url)
    n, last = F.size(parts), F.get(parts, F.size(parts) - 1)
    return (n == 0) | ((n == 1) & F.lower(last).isin(*sections)) | F.lower(F.get(parts, F.lit(0))).isin("tag", "tags") | ((n >= 2) & (F.lower(F.get(parts, n - 2)) == "page") & last.rlike("^[0-9]+$"))


def category(url: Column, sitemap: Column | None = None) -> Column:
    """Document category from the sitemap's name, else from the path."""
    out = None
    for source in ([sitemap] if sitemap is not None else []) + [url_part(url, 3)]:
        low = F.lower(source)
        found = F.when(low.rlike("review|test"), "review").when(low.rlike("news"), "news").when(low.rlike("blog"), "blog").when(low.rlike("article|feature|guide"), "article")
        out = found if out is None else F.coalesce(out, found)
    return F.coalesce(out, F.lit("unknown"))


def safe_name(url: Column) -> Column:
    """File name: the path's harmless characters and ten digits of the URL's SHA-1."""
    base = F.regexp_replace(F.regexp_replace(url_part(url, 3), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat_ws("-", F.substring(F.when(base == "", "index").otherwise(base), 1, 80), F.substring(F.sha1(url.cast("binary")), 1, 10))


def response_class(status: Column, body: Column) -> Column:
    """One of eight classes of an HTTP answer; challenges are told by title and DOM, whatever the status.

    A sitemap is never a challenge. Only pages with a marker in their first 200,000 characters go to Python.
    """
    whole = F.coalesce(body, F.lit(""))
    head = F.substring(whole, 1, 200_000)
    opening = F.when(head.rlike("<(?:[A-Za-z0-9_.-]++:)?(?:urlset|sitemapindex)"), F.regexp_replace(head, r"\G(?:[\s\x{feff}]++|<\?xml[^>]*+>|(?s:<!--.*?-->))", ""))
    sitemap = F.coalesce(opening.rlike(r"^<(?:[A-Za-z0-9_.-]++:)?(?:urlset|sitemapindex)[\s>]"), F.lit(False))
    asked = F.when(~sitemap & F.lower(head).rlike("|".join((*_HINTS, *CHALLENGES))), head)
    return (
        F.when(is_challenge(asked), "anti_bot").when(status.isin(404, 410), "not_found").when(status == 429, "rate_limited")
        .when(status.between(500, 599) | (sitemap & (status >= 500)), "server_error").when(status.between(300, 399) & ~sitemap, "redirect").when(~status.between(200, 299) | status.isNull(), "http_error")
        .when(F.trim(whole, F.lit(" \t\r\n")) == "", "empty").otherwise("valid")
    )


def retry_delay(header: Column, now: Column, default: int = 60) -> Column:
    """Seconds from a Retry-After header (a number, or an HTTP date in GMT), at least ``default``."""
    seconds = F.when(header.rlike("^[0-9]{1,9}$"), F.nullif(F.regexp_extract(header, "^([0-9]{1,9})$", 1), F.lit("")).cast("long"))
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(header, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.greatest(F.coalesce(seconds, date - now, F.lit(default)), F.lit(default))


def meta_content(html: Column, name: str) -> Column:
    """Content of the meta tag with that name or property; null without one."""
    escaped = re.escape(name)
    a = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["']{escaped}["'][^>]*\scontent\s*=\s*["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content\s*=\s*["']([^"']*)["'][^>]*\s(?:name|property)\s*=\s*["']{escaped}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_NOISE = frozenset("script style noscript template svg nav aside footer form iframe button".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BODY = ("articleBody", "article", "main")


class _Page(HTMLParser):
    """Visible text, title, candidate article bodies and JSON-LD scripts of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.scripts, self.bodies = [], [], [], []
        self.stack: list[tuple[str, bool, list | None]] = []
        self.hidden, self.in_title, self.in_ld = 0, False, False
        self.open: list[tuple[str, list]] = []

    def _put(self, data: str) -> None:
        self.text.append(data)
        for _, parts in self.open:
            parts.append(data)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _BLOCKS:
            self._put("\n")
        if tag in _VOID:
            return
        noise = tag in _NOISE
        self.hidden += noise
        self.in_title |= tag == "title"
        self.in_ld = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
        if self.in_ld:
            self.scripts.append("")
        kind = "articleBody" if "articleBody" in (a.get("itemprop") or "").split() else tag if tag in _BODY else None
        parts: list | None = [] if kind else None
        if kind:
            self.open.append((kind, parts))
        self.stack.append((tag, noise, parts))

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self._put("\n")
        if all(t != tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, noise, parts = self.stack.pop()
            self.hidden -= noise
            if parts is not None:
                self.open = [o for o in self.open if o[1] is not parts or self.bodies.append(o)]
            if t == "title":
                self.in_title = False
            if t == "script":
                self.in_ld = False
            if t == tag:
                break

    def handle_data(self, data):
        if self.in_ld:
            self.scripts[-1] += data
        elif self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self._put(data)


class _Challenge(HTMLParser):
    """What tells an interstitial: its forms, its widgets, the visible text and whether an article has text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.form = self.widget = self.article = False
        self.text: list[str] = []
        self.stack: list[tuple[str, bool, bool, bool, frozenset]] = []  # tag, unseen, no text, in an article's body, marks for descendants

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        own, classes = a.get("id", ""), set(a.get("class", "").split())
        _, unseen, silent, inside, marks = self.stack[-1] if self.stack else ("", False, False, False, frozenset())
        self.form |= own in ("challenge-form", "cf-challenge-running", "px-captcha") or (tag == "form" and "/cdn-cgi/challenge-platform/" in a.get("action", ""))
        unseen |= tag in ("script", "style", "noscript", "template")
        silent |= tag in ("script", "style", "template")
        frame = tag == "iframe" and ("recaptcha" in a.get("src", "") or "hcaptcha" in a.get("src", ""))
        self.widget |= not unseen and (frame or bool(classes & {"g-recaptcha", "h-captcha", "cf-turnstile"}))
        if tag in _VOID:
            return
        column = "content-row__section" in classes or ("content-row__center--lg" in classes and "js-comment-section" not in classes)
        inside |= (
            own == "article-body" or (tag == "article" and own == "material_content")
            or (tag == "div" and (bool(classes & {"article-content", "content-text", "article_body_content"}) or "material-content_" in a.get("class", "") or (own.startswith("publication-") and "prose" in classes)))
            or ("h-entry" in marks and "e-content" in classes) or ("gallery-body" in marks and "gallery-text" in classes)
            or ("news-details" in marks and tag == "div" and "content-row__content" in classes) or ("reviews-details" in marks and tag == "div" and column)
        )
        if tag == "article":
            marks |= classes & {"h-entry", "news-details", "reviews-details"}
        if own == "gallery-body":
            marks |= {own}
        self.stack.append((tag, unseen, silent, inside, marks))

    def handle_endtag(self, tag):
        if any(t[0] == tag for t in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        _, unseen, silent, inside, _ = self.stack[-1] if self.stack else ("", False, False, False, None)
        if not unseen:
            self.text.append(data)
        self.article |= inside and not silent and bool(data.strip())


def challenge(page: str) -> bool:
    """Is the page an interstitial? A marker in a story or a script is no evidence.

    In a short page without an article, visible words of ``_PLAIN`` count besides those of ``CHALLENGES``.
    """
    title = re.search(r"<title[^>]*>(.*?)</title>", page.casefold(), re.S)
    title = " ".join(title[1].split()) if title else ""
    if any(m in title for m in CHALLENGES) or title.strip(" .!:") in ("captcha", "капча", "ddos-guard"):
        return True
    dom = _Challenge()
    dom.feed(page)
    dom.close()
    if dom.form or dom.article:
        return dom.form
    visible = " ".join(" ".join(dom.text).casefold().split())
    return dom.widget or (len(visible) < 3000 and any(m in visible for m in (*CHALLENGES, *_PLAIN)))


@F.pandas_udf(T.BooleanType())
def is_challenge(pages: pd.Series) -> pd.Series:
    """``challenge`` of a column; false for null."""
    return pages.map(lambda p: p is not None and challenge(p)).astype(bool)


def tidy(text: str) -> str:
    """The same rule as ``functions.text.clean_text``, entities resolved."""
    t = re.sub("\r\n?", "\n", _html.unescape(text))
    t = re.sub("[ \t\u00a0]+", " ", t)
    t = re.sub(" *\n *", "\n", t)
    return re.sub("\n{3,}", "\n\n", t).strip(" \n")


def _walk(node):
    """All JSON objects in ``node``, graphs included, outer ones first; no recursion, so that deep nesting is harmless."""
    queue = [node]
    while queue:
        x = queue.pop(0)
        if isinstance(x, dict):
            yield x
            queue.extend(v for v in x.values() if isinstance(v, (dict, list)))
        elif isinstance(x, list):
            queue.extend(x)


def json_ld(scripts: list[str]) -> list[dict]:
    out = []
    for s in scripts:
        try:
            out += list(_walk(json.loads(s)))
        except (ValueError, RecursionError):
            continue
    return out


def _name(value) -> str | None:
    if isinstance(value, list):
        names = [n for n in map(_name, value) if n]
        return ", ".join(dict.fromkeys(names)) or None
    if isinstance(value, dict):
        value = value.get("name")
    return value.strip() or None if isinstance(value, str) else None


def parse_page(html: str | None) -> tuple:
    """``(title, text, body, author, published_at, section, keywords)`` of a page.

    The body is the longest of the marked article bodies with at least 30 words, else all visible text.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    page.bodies += page.open
    text = tidy("".join(page.text))
    bodies = [tidy("".join(parts)) for _, parts in page.bodies]
    bodies = [b for b in bodies if len(b.split()) >= 30]
    types = ("Article", "NewsArticle", "BlogPosting", "Review")
    found = next((o for o in json_ld(page.scripts) if any(t in types for t in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")]))), {})
    keywords = found.get("keywords")
    keywords = keywords.split(",") if isinstance(keywords, str) else keywords if isinstance(keywords, list) else []
    keywords = list(dict.fromkeys(k.strip() for k in keywords if isinstance(k, str) and k.strip()))
    title = tidy("".join(page.title)) or _name(found.get("headline"))
    return title or None, text, max(bodies, key=len) if bodies else text, _name(found.get("author")), _name(found.get("datePublished")), _name(found.get("articleSection")), keywords


_PARSED = T.StructType([*(T.StructField(n, T.StringType()) for n in ("title", "text", "body", "author", "published_at", "section")), T.StructField("keywords", T.ArrayType(T.StringType()))])


#: Pages that are parsed before their results go back.
PAGES = 256


@F.arrow_udf(_PARSED)
def parse_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``parse_page`` of a column.

    A batch stays in Arrow's buffer but for ``PAGES`` of it at a time, so that a worker doesn't hold the strings, texts and
    bodies of all pages of a batch.
    """
    kinds = [*[pa.string()] * 6, pa.list_(pa.string())]
    for batch in batches:
        for lo in range(0, max(len(batch), 1), PAGES):
            rows = [parse_page(p) for p in batch.slice(lo, PAGES).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_PARSED.names)


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: parse_page(p)[1])
