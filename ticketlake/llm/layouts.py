"""Labelled pages for training: texts laid out by common page designs, whose parts are known."""

from __future__ import annotations

import html
import random

# Words that page authors use for parts of a page, by part. Fixed values of the training layouts.
PARTS = {
    "content": "content main-content article article-body post post-content entry entry-content story story-body text body-text page-content maincontent articleBody",
    "nav": "nav navbar menu main-menu breadcrumb breadcrumbs navigation topnav pagination tabs site-nav",
    "header": "header site-header masthead banner top-bar logo branding page-header",
    "footer": "footer site-footer bottom copyright legal colophon page-footer",
    "sidebar": "sidebar side aside widget related recommended popular trending recent-posts right-rail more-stories",
    "notice": "notice cookie cookie-banner consent alert gdpr popup modal newsletter subscribe message disclaimer",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot adsbox advert-block",
    "form": "form search search-form login signup contact-form subscribe-form feedback",
    "comments": "comments comment-list reader-comments reply discussion responses user-comments comment-thread",
    "meta": "share social byline meta author date tags post-meta sharing",
    "plain": "container wrapper row col inner block section box grid page site layout wrap outer",
}
_TAGS = {
    "nav": ("nav", "div", "ul"),
    "header": ("header", "div"),
    "footer": ("footer", "div"),
    "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "p", "aside"),
    "ad": ("div", "aside", "section", "p"),
    "form": ("form", "div"),
    "comments": ("section", "div", "ol"),
    "meta": ("div", "p", "ul"),
}
#: Marks the text that belongs to the article; the label maker takes it out again.
MARK = "\ue000"


class Layout:
    """One random page; ``sentences`` are texts to fill it with."""

    def __init__(self, seed: int, sentences: list[str]):
        self.r = random.Random(seed)
        self.sentences = sentences
        self.named = self.r.random() < 0.85  # else classes say nothing

    def say(self, least: int, most: int) -> str:
        return html.escape(" ".join(self.r.choice(self.sentences) for _ in range(self.r.randint(least, most))))

    def few(self, least: int, most: int) -> str:
        words = self.say(1, 1).split()
        return " ".join(words[: self.r.randint(least, most)]) or "x"

    def names(self, part: str) -> str:
        if self.r.random() < 0.15:
            return ""
        name = self.r.choice(PARTS[part].split()) if self.named else f"c{self.r.randint(10, 99)}"
        kind = self.r.choice(("class", "class", "id"))
        return f' {kind}="{name}"'

    def wrap(self, part: str, inside: str, tag: str | None = None) -> str:
        tag = tag or self.r.choice(_TAGS[part])
        names = self.names(part)
        if not names and tag in ("div", "section", "p", "ul", "ol"):
            names = f' class="{self.r.choice(PARTS[part].split())}"'  # something has to tell the part
        return f"<{tag}{names}>{inside}</{tag}>"

    def links(self, least: int, most: int) -> str:
        items = [f'<a href="/{i}">{self.few(1, 4)}</a>' for i in range(self.r.randint(least, most))]
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", "<br>")).join(items)

    def boiler(self, part: str) -> str:
        r = self.r
        if part == "nav":
            return self.wrap(part, self.links(3, 12))
        if part == "header":
            inside = r.choice((f"<h1>{self.few(1, 5)}</h1>", f"<p>{self.few(2, 8)}</p>", f'<a href="/">{self.few(1, 3)}</a>', ""))
            return self.wrap(part, inside + (self.boiler("nav") if r.random() < 0.4 else f"<span>{self.few(1, 6)}</span>"))
        if part == "footer":
            return self.wrap(part, r.choice(("&copy; ", "Copyright ", "")) + self.few(1, 6) + " &middot; " + self.say(0, 2) + (self.links(2, 8) if r.random() < 0.4 else ""))
        if part == "sidebar":
            blurbs = "".join(f"<p>{self.say(1, 2)}</p>" for _ in range(r.randint(0, 3)))
            return self.wrap(part, f"<h3>{self.few(1, 4)}</h3>" * (r.random() < 0.7) + blurbs + (self.links(2, 10) if r.random() < 0.7 or not blurbs else ""))
        if part in ("notice", "ad"):
            text = self.say(1, 3)
            return self.wrap(part, text if r.random() < 0.6 else f"<p>{text}</p>" + f'<a href="#">{self.few(1, 3)}</a>' * (r.random() < 0.4))
        if part == "form":
            return self.wrap(part, f"<label>{self.few(1, 5)}</label><input><p>{self.say(0, 1)}</p><button>{self.few(1, 2)}</button>")
        if part == "comments":
            tag = r.choice(("div", "li", "article", "p"))
            one = lambda: f'<{tag}{self.names("comments")}><b>{self.few(1, 2)}</b> {self.say(1, 4)}</{tag}>' if tag == "p" else f'<{tag}{self.names("comments")}><div>{self.few(1, 2)}</div><p>{self.say(1, 4)}</p></{tag}>'
            return self.wrap(part, f"<h3>{self.few(1, 3)}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6))))
        return self.wrap("meta", self.few(1, 8) if r.random() < 0.5 else self.links(2, 5))

    def block(self) -> str:
        """A block of the article."""
        r, m = self.r, MARK
        kind = r.random()
        if kind < 0.7:
            text = m + self.say(1, 6)
            if r.random() < 0.2:
                text = f"<b>{text}<br>" if r.random() < 0.5 else f'{text} <a href="/x">{self.few(1, 3)}</a>.'
            return f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{text}"
        if kind < 0.8:
            return f"<h2>{m}{self.few(2, 8)}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{m}{self.say(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{m}{self.say(1, 2)}</p></blockquote>"
        if kind < 0.95:
            return f"<pre>{m}{self.few(3, 20)}</pre>"
        if kind < 0.98:
            rows = "".join(f"<tr><td>{m}{self.few(1, 4)}</td><td>{m}{self.few(1, 4)}</td></tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        return f"<figure><img src=x><figcaption>{m}{self.say(1, 1)}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        title = f"<h1>{MARK}{self.few(3, 12)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}{self.boiler('meta') if r.random() < 0.5 else ''}</header>"
        blocks = [self.block() for _ in range(r.choice((1, 2, 4, 8, 16)))]
        for part, share in (("ad", 0.25), ("meta", 0.2), ("sidebar", 0.1), ("form", 0.1), ("notice", 0.08)):
            if r.random() < share:
                blocks.insert(r.randint(0, len(blocks)), self.boiler(part))
        inside = (title if r.random() < 0.85 else "") + "".join(blocks)
        if r.random() < 0.15:
            inside += self.boiler("comments")
        tag = r.choice(("article", "article", "main", "div", "div", "section", "td"))
        if tag == "td":
            return f"<table><tr><td{self.names('content')}>{inside}</td></tr></table>"
        names = self.names("content")
        return f"<{tag}{names}>{inside}</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [p for p, share in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("ad", 0.35), ("sidebar", 0.15), ("form", 0.1)) if r.random() < share]
        after = [p for p, share in (("comments", 0.4), ("sidebar", 0.35), ("ad", 0.2), ("form", 0.1), ("notice", 0.15), ("nav", 0.15), ("footer", 0.75)) if r.random() < share]
        r.shuffle(before)
        body = [self.boiler(p) for p in before] + [self.article()] + [self.boiler(p) for p in after]
        inside = "".join(body)
        if r.random() < 0.35:
            middle = "".join(body[:-1])
            inside = f"<div{self.names('plain')}>{middle}</div>{body[-1]}"
        if r.random() < 0.3:
            inside = f"<div{self.names('plain')}>{inside}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.few(2, 8)}</title><style>p{{}}</style></head><body>{inside}</body></html>"
