"""Training pages made by a fixed rule: articles and what surrounds them, marked by `data-label`."""

from __future__ import annotations

import random
from html import escape

# Names that page authors give to the parts of a page.
MAIN_NAMES = ("content", "post", "entry-content", "article-body", "story", "main", "post-content", "text", "articleBody", "page-content", "blog-post")
OTHER_NAMES = {
    "menu": ("nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs", "topnav", "pagination", "toc"),
    "header": ("header", "masthead", "site-header", "banner", "logo", "topbar", "tagline"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "bottom", "legal"),
    "sidebar": ("sidebar", "widget", "related", "rail", "aside", "popular", "recommended", "trending", "secondary", "more-stories"),
    "notice": ("notice", "cookie", "cookie-banner", "alert", "consent", "newsletter", "popup", "modal", "subscribe", "paywall", "disclaimer", "promo"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "adsbox", "promo-box", "banner-ad"),
    "form": ("search", "login", "signup", "contact-form", "search-form", "subscribe-form"),
    "comments": ("comments", "comment-list", "responses", "discussion", "replies", "disqus", "comment", "respond"),
    "share": ("share", "social", "share-buttons", "tags", "meta", "byline", "author-box"),
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


def labelled_pages(pieces: list[str], count: int, seed: int = 17) -> list[str]:
    """`count` pages whose texts are drawn from `pieces`."""
    draw = random.Random(seed)
    words = [w for p in pieces[:2000] for w in p.split()][:200_000] or ["text", "word", "and", "more"]
    long = [p for p in pieces if len(p.split()) >= 12] or [" ".join(words[:30])]

    def some(low: int, high: int) -> str:
        begin = draw.randrange(max(1, len(words) - high))
        return escape(" ".join(words[begin : begin + draw.randint(low, high)]))

    def paragraph() -> str:
        return escape(draw.choice(long)) if draw.random() < 0.8 else some(1, 25)

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{n}">{some(1, 4)}</a>' for n in range(draw.randint(low, high))]
        shape = draw.randrange(3)
        if shape == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items) if shape == 1 else "".join(f"<div>{i}</div>" for i in items)

    def inside(kind: str) -> str:
        if kind in ("menu", "share"):
            return links(2, 9) if draw.random() < 0.85 else some(1, 8)
        if kind == "header":
            return draw.choice([f"<h1>{some(1, 4)}</h1><p>{some(2, 10)}</p>", f'<a href="/">{some(1, 3)}</a>', f"<div>{some(1, 6)}</div>{links(2, 6)}"])
        if kind == "footer":
            return draw.choice([f"&copy; {some(1, 12)}", f"<p>&copy; {some(2, 20)}</p>{links(2, 6)}", f"{some(1, 5)} &middot; {some(3, 15)}", f"<p>{paragraph()}</p>"])
        if kind == "sidebar":
            return f"<h3>{some(1, 4)}</h3>" + draw.choice([links(3, 8), f"<p>{some(5, 40)}</p>", f"<p>{paragraph()}</p>{links(2, 5)}"])
        if kind == "notice":
            return draw.choice([f"<p>{some(6, 30)}</p>", some(4, 20), f"<p>{some(6, 30)}</p><button>{some(1, 2)}</button>", f"<h3>{some(1, 4)}</h3><p>{paragraph()}</p>"])
        if kind == "advert":
            return draw.choice([some(3, 15), f'<a href="/x">{some(2, 8)}</a>', f"<p>{some(5, 30)}</p>", f"<h4>{some(1, 4)}</h4><p>{paragraph()}</p>"])
        if kind == "form":
            return f"<p>{some(1, 12)}</p><input type='text'><button>{some(1, 2)}</button>"
        body = "".join(f'<div class="{draw.choice(["comment", "reply", "item", "comment-body"])}"><p>{draw.choice([some(3, 40), paragraph()])}</p></div>' for _ in range(draw.randint(1, 6)))
        return draw.choice([f"<h3>{some(1, 3)}</h3>", ""]) + body

    def other(kind: str) -> str:
        semantic, name = SEMANTIC.get(kind), draw.choice(OTHER_NAMES[kind])
        tag = semantic if semantic and draw.random() < 0.6 else draw.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        attribute = "" if tag == semantic and draw.random() < 0.6 else f' {draw.choice(["class", "class", "id"])}="{name}"'
        if tag == "ul":
            return f'<ul{attribute} data-label="other">' + "".join(f'<li><a href="/">{some(1, 3)}</a></li>' for _ in range(draw.randint(2, 8))) + "</ul>"
        return f'<{tag}{attribute} data-label="other">{inside(kind)}</{tag}>'

    def main() -> str:
        blocks = []
        for _ in range(draw.randint(1, 12)):
            shape = draw.random()
            if shape < 0.75:
                blocks.append(f"<p>{paragraph()}</p>")
            elif shape < 0.82:
                blocks.append(f"<h2>{some(2, 8)}</h2><p>{paragraph()}</p>")
            elif shape < 0.87:
                blocks.append("<ul>" + "".join(f"<li>{some(2, 25)}</li>" for _ in range(draw.randint(2, 6))) + "</ul>")
            elif shape < 0.92:
                blocks.append(f"<blockquote><p>{paragraph()}</p></blockquote>")
            elif shape < 0.95:
                blocks.append(f"<p><b>{paragraph()}<br><p>{paragraph()}</p>")
            else:
                blocks.append(f"<table><tr><td>{some(1, 6)}</td><td>{some(1, 6)}</td></tr></table>")
            if draw.random() < 0.08:
                blocks.append(other(draw.choice(["advert", "share", "notice", "sidebar", "form"])))
        title = draw.choice([f"<h1>{some(2, 12)}</h1>", f"<h1>{some(2, 12)}</h1>", f"<header><h1>{some(2, 12)}</h1></header>", ""])
        body = title + "".join(blocks)
        if draw.random() < 0.2:
            body = title + f'<div class="{draw.choice(MAIN_NAMES)}">' + "".join(blocks) + "</div>"
        if draw.random() < 0.15:
            body += other(draw.choice(["comments", "share", "footer"]))
        tag = draw.choice(["article", "article", "main", "div", "div", "section"])
        attribute = "" if tag in ("article", "main") and draw.random() < 0.6 else f' {draw.choice(["class", "id"])}="{draw.choice(MAIN_NAMES)}"'
        found = f'<{tag}{attribute} data-label="main">{body}</{tag}>'
        if tag == "article" and draw.random() < 0.2:
            found = f"<main>{found}</main>"
        return found

    pages = []
    for _ in range(count):
        before = [other(k) for k in ("header", "menu", "notice", "advert", "form") if draw.random() < 0.45]
        after = [other(k) for k in ("comments", "sidebar", "share", "advert", "notice", "footer") if draw.random() < 0.45]
        draw.shuffle(before)
        body = "".join(before) + main() + "".join(after)
        if draw.random() < 0.3:
            body = f'<div class="{draw.choice(["wrapper", "container", "page", "site", "row"])}">{body}</div>'
        pages.append(f"<html><head><title>{some(1, 6)}</title></head><body>{body}</body></html>")
    return pages
