"""Labelled pages for fitting the extraction model: a bounded set, generated by rule, as no labelled pages are given.

Containers carry ``data-keep``; the parser reads the marks as labels and no feature sees them.
"""

from __future__ import annotations

import random
from collections.abc import Callable

SYLLABLES = "ba co den el fi gor hu in jo ka lem mi nor on pra qui ra so ten un va wer xi yo zu st an er the of".split()

# Names that the generated sites use; each list is one kind of container.
NAMES = {
    "wrap": ["wrap", "wrapper", "container", "site", "page-wrap", "row", "col-8", "grid", "layout", "inner", "root", "app", "outer", "column", "region"],
    "main": ["content", "main", "main-content", "primary", "page-content", "content-area", "col-main", "site-content"],
    "article": ["article", "post", "entry", "entry-content", "article-body", "post-content", "story", "story-body", "text", "hentry", "post-body", "body-copy", "single", "prose"],
    "header": ["header", "site-header", "masthead", "top", "topbar", "page-header", "branding", "head"],
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "topnav", "links", "breadcrumb", "breadcrumbs", "pagination", "skip-links"],
    "aside": ["sidebar", "side", "widget", "rail", "secondary", "col-side", "widget-area", "related", "popular", "trending", "recommended", "more-stories"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adsense", "promoted", "sponsor"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "popup", "modal", "subscribe", "disclaimer", "paywall-notice"],
    "comments": ["comments", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments", "comment-thread", "reactions", "comments-area", "commentlist", "comment-section", "user-comments", "reviews"],
    "title": ["entry-header", "post-header", "article-header", "title", "post-title", "entry-title", "headline", "story-header"],
    "footer": ["footer", "site-footer", "foot", "colophon", "bottom", "copyright", "legal", "page-footer"],
    "share": ["share", "social", "share-bar", "tags", "meta", "byline", "toolbar", "rating"],
}


class Site:
    """Draws one page."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.bare = self.r.random() < 0.15  # no class names at all
        self.loose = self.r.random() < 0.3  # leaves out end tags of paragraphs and items

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        w = [self.word() + (self.r.choice(",..;") if self.r.random() < 0.12 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(w).capitalize() + self.r.choice((".", ".", ".", "?", ""))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 4)))}</a>'

    def named(self, kind: str, tag: str = "div", keep: str = "") -> str:
        bare = self.bare and kind not in ("ad", "notice", "comments", "share")  # without a name these look like text
        attrs = "" if bare else f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(NAMES[kind])}{self.r.choice(("", "", " " + self.word()))}"'
        return f"<{tag}{attrs}{keep and f' data-keep={keep}'}>"

    def paragraph(self, low: int, high: int) -> str:
        text = self.words(low, high)
        if self.r.random() < 0.25:
            text += f" {self.r.choice(('<b>', '<em>', '<strong>', '<b>'))}{self.words(2, 12)}" + self.r.choice(("</b>", "</em>", "</strong>", "<br>"))
        if self.r.random() < 0.25:
            text += " " + self.link() + " " + self.words(3, 15)
        return f"<p>{text}" + ("" if self.loose else "</p>")

    def items(self, low: int, high: int, make: Callable[[], str], tag: str = "ul") -> str:
        end = "" if self.loose else "</li>"
        return f"<{tag}>" + "".join(f"<li>{make()}{end}" for _ in range(self.r.randint(low, high))) + f"</{tag}>"

    def block(self) -> str:
        """A part of an article."""
        x = self.r.random()
        if x < 0.62:
            return self.paragraph(*self.r.choice(((1, 3), (1, 8), (4, 14), (15, 60), (40, 160))))
        if x < 0.74:
            return f"<h{(h := self.r.choice('234'))}>{self.words(2, 8)}</h{h}>"
        if x < 0.82:
            return self.items(2, 6, lambda: self.words(3, 25), self.r.choice(("ul", "ol")))
        if x < 0.87:
            return f"<blockquote>{self.paragraph(8, 40)}</blockquote>"
        if x < 0.9:
            return f"<pre>{self.words(5, 30)}</pre>"
        if x < 0.93:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if x < 0.96:
            return f"<figure><img src=x><figcaption>{self.words(4, 15)}</figcaption></figure>"
        return f"<div>{self.words(10, 60)}</div>"

    def nav(self) -> str:
        inner = self.items(3, 9, self.link) if self.r.random() < 0.7 else " | ".join(self.link() for _ in range(self.r.randint(3, 8)))
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        if tag == "ul":
            return self.named("nav", "div", "0") + self.items(3, 9, self.link) + "</div>"
        return self.named("nav", tag, "0") + inner + f"</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "div"))
        logo = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 8)}</p>", self.link(), f"<div>{self.words(1, 4)}</div>"))
        return self.named("header", tag, "0") + logo + (self.nav() if self.r.random() < 0.5 else "") + (self.form() if self.r.random() < 0.3 else "") + f"</{tag}>"

    def form(self) -> str:
        return f'<form action="/s" data-keep=0><label>{self.words(1, 4)}</label><input name=q>{self.r.choice(("", f"<p>{self.words(4, 15)}</p>"))}<button>{self.word()}</button></form>'

    def aside(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        parts = [self.r.choice((self.items(2, 6, self.link), self.paragraph(5, 50), self.items(2, 5, lambda: self.words(2, 9)), self.form())) for _ in range(self.r.randint(1, 3))]
        return self.named("aside", tag, "0") + f"<h3>{self.words(1, 4)}</h3>" + "".join(parts) + f"</{tag}>"

    def ad(self) -> str:
        return self.named("ad", self.r.choice(("div", "div", "section")), "0") + self.r.choice((self.words(4, 40), self.paragraph(4, 40), self.link(), self.paragraph(3, 15) + self.link())) + "</div>"

    def notice(self) -> str:
        return self.named("notice", self.r.choice(("div", "div", "section")), "0") + self.paragraph(5, 45) + self.r.choice(("", self.form(), self.link(), "<button>OK</button>")) + "</div>"

    def comments(self) -> str:
        def one() -> str:
            tag = self.r.choice(("div", "div", "div", "article", "section"))
            name = f' class="{self.r.choice(("comment", "comment-body", "reply", "comment-content", "post-comment"))}"'
            who = self.r.choice((f"<b>{self.word()}</b>", f"<footer>{self.word()}</footer>", f"<h4>{self.word()}</h4>", f"<p>{self.word()} <time>1 May</time></p>"))
            return f"<{tag}{name}>{who}" + "".join(self.paragraph(*self.r.choice(((1, 10), (10, 70), (40, 160)))) for _ in range(self.r.choice((1, 1, 2, 3)))) + f"</{tag}>"

        tag = self.r.choice(("section", "div"))
        how = self.r.random()
        if how < 0.5:
            inside = "".join(one() for _ in range(self.r.randint(1, 6)))
        elif how < 0.75:
            inside = self.items(1, 6, lambda: self.words(1, 3) + self.paragraph(4, 100), self.r.choice(("ol", "ul")))
        else:
            inside = self.items(1, 5, one, "ol")
        if self.r.random() < 0.3:
            inside = self.named("comments") + inside + "</div>"
        return self.named("comments", tag, "0") + f"<h{(h := self.r.choice('23'))}>{self.words(1, 3)}</h{h}>" + inside + (self.form() if self.r.random() < 0.4 else "") + f"</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        return self.named("footer", tag, "0") + self.r.choice((f"&copy; {self.word()} &middot; {self.words(4, 30)}", self.paragraph(4, 30), self.items(2, 6, self.link) + self.words(3, 12))) + f"</{tag}>"

    def share(self) -> str:
        return self.named("share", "div", "0") + self.r.choice((self.items(2, 5, self.link), self.words(2, 6), self.link() + self.link())) + "</div>"

    def article(self) -> str:
        title = f"<h1>{self.words(*self.r.choice(((1, 3), (2, 14))))}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.35:
            title = self.r.choice((f"<header>{title}</header>", self.named("title") + title + "</div>", self.named("title", "header") + title + "</header>"))
        blocks = [self.block() for _ in range(self.r.choice((1, 2, 3, 5, 8, 12, 18)))]
        plain = self.r.random() < 0.4
        for make, chance in ((self.ad, 0.35), (self.share, 0.35), (self.aside, 0.2), (self.notice, 0.2), (self.nav, 0.1)):
            if not plain and self.r.random() < chance:
                blocks.insert(self.r.randint(0, len(blocks)), make())
        if not plain and self.r.random() < 0.15:
            blocks.append(self.comments())
        body = title + "".join(blocks)
        tag = self.r.choice(("article", "article", "div", "div", "section", "main"))
        if tag == "article" and self.r.random() < 0.6:
            return f"<article data-keep=1>{body}</article>"
        if self.r.random() < 0.3:
            body = title + self.named("article") + "".join(blocks) + "</div>"
        return self.named("article", tag, "1") + body + f"</{tag}>"

    def page(self) -> str:
        parts = [self.article()] if self.r.random() < 0.96 else []
        if self.r.random() < 0.45:
            parts.append(self.comments())
        if self.r.random() < 0.4:
            parts.insert(self.r.choice((0, len(parts))), self.aside())
        for make, chance in ((self.ad, 0.3), (self.notice, 0.15), (self.share, 0.2), (self.nav, 0.2)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(0, len(parts)), make())
        inner = "".join(parts)
        for _ in range(self.r.choice((0, 0, 1, 1, 2, 3))):
            inner = self.r.choice((self.named("wrap"), self.named("main"), self.named("main"), "<div>", "<main>", self.named("main", "main"))) + inner
            inner += "</main>" if inner.startswith("<main") else "</div>"
        top = (self.header() if self.r.random() < 0.6 else "") + (self.nav() if self.r.random() < 0.6 else "")
        top += (self.ad() if self.r.random() < 0.3 else "") + (self.notice() if self.r.random() < 0.25 else "")
        end = (self.aside() if self.r.random() < 0.25 else "") + (self.notice() if self.r.random() < 0.15 else "") + (self.footer() if self.r.random() < 0.8 else "")
        text = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{top}{inner}{end}</body></html>"
        return text[: self.r.randint(len(text) // 2, len(text))] if self.r.random() < 0.1 else text


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """``n`` pages; the same ones for the same ``seed``."""
    return [Site(seed * 1_000_003 + i).page() for i in range(n)]
