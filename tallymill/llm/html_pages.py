"""Pages made up for training the HTML extractor: trees of main text and of what surrounds it, in many layouts.

Elements of the main text are marked with the attribute ``data-gold``, which only training reads.
"""

from __future__ import annotations

import html
import random

#: Words of class and id attributes that page authors give to parts of a page.
NAMES = {
    "header": "header masthead topbar page-header site-header branding logo",
    "menu": "nav navbar menu main-menu breadcrumb breadcrumbs tabs navigation toc skip-links pagination pager",
    "ad": "ad ads advert advertisement adsbox banner sponsored sponsor promo promotion ad-slot adunit teaser-ad commercial affiliate",
    "notice": "cookie cookie-banner consent gdpr notice alert popup modal overlay paywall subscribe-notice disclaimer privacy-notice announcement",
    "sidebar": "sidebar side aside widget rail secondary related related-posts recommended popular trending more-stories tags tag-list",
    "comments": "comments comment comment-list discussion replies reply disqus user-comments feedback reviews respond comment-body",
    "form": "form newsletter subscribe signup search search-box login contact-form poll",
    "share": "share social share-buttons social-links toolbar actions print follow",
    "footer": "footer site-footer copyright legal colophon bottom credits imprint",
    "main": "article content main post entry story post-content entry-content article-body main-content text body-text page-content",
    "neutral": "container wrapper row col inner box section block left right grid wrap page outer clearfix",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = [a + b + c for a in "b c d f g l m n p r s t th st v".split() for b in "aeiou" for c in ("", "n", "r", "s", "l")]
        self.vocabulary = ["".join(self.r.choice(syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3)))) for _ in range(900)]

    def words(self, least: int, most: int) -> str:
        own = [self.r.choice(self.vocabulary) for _ in range(self.r.randint(least, most))]
        text = " ".join(w + self.r.choice(("", "", "", "", "", "", ",", ".")) for w in own)
        if self.r.random() < 0.05:
            text = " | ".join(own)
        return html.escape(text[:1].upper() + text[1:] + self.r.choice((".", ".", "", " & co", "!")))

    def name(self, kind: str, likely: float = 0.85) -> str:
        pick = self.r.choice(NAMES[kind]) if self.r.random() < likely else self.r.choice(NAMES["neutral"]) if self.r.random() < 0.5 else ""
        if not pick:
            return ""
        more = f" {self.r.choice(NAMES['neutral'])}" if self.r.random() < 0.25 else ""
        return f' {self.r.choice(("class", "class", "class", "id"))}="{pick}{more}"'

    def element(self, tag: str, inside: str, attributes: str = "", gold: bool = False, close: bool = True) -> str:
        return f"<{tag}{attributes}{' data-gold=1' if gold else ''}>{inside}" + (f"</{tag}>" if close else "")

    def links(self, n: int) -> str:
        item = lambda: self.element("a", self.words(1, 3), ' href="/x"')
        if self.r.random() < 0.75:
            return self.element("ul", "".join(self.element("li", item()) for _ in range(n)))
        return self.r.choice((" ", " | ", "\n")).join(item() for _ in range(n))

    def paragraph(self, gold: bool) -> str:
        r = self.r
        size = r.choice(((1, 4), (3, 9), (12, 40), (30, 90), (60, 160)))
        text = self.words(*size)
        if r.random() < 0.2:
            text += f" <a href='/y'>{self.words(1, 4)}</a> {self.words(2, 9)}"
        if r.random() < 0.15:
            text = f"<b>{text}<br>" if r.random() < 0.5 else f"<em>{text}</em>"
        return self.element("p", text, gold=gold, close=r.random() < 0.85)

    def list_(self, gold: bool) -> str:
        items = "".join(self.element("li", self.words(3, 25), gold=gold) for _ in range(self.r.randint(2, 6)))
        return self.element(self.r.choice(("ul", "ol")), items, gold=gold)

    def table(self) -> str:
        rows = "".join(self.element("tr", "".join(self.element("td", self.words(1, 4), gold=True) for _ in range(3)), gold=True) for _ in range(self.r.randint(2, 4)))
        return self.element("table", rows, gold=True)

    def aside(self, kind: str) -> str:
        """A part of a page that isn't main text."""
        r = self.r
        if kind == "header":
            inside = self.element(r.choice(("div", "a", "h1", "p")), self.words(1, 6)) + (self.element("p", self.words(3, 10)) if r.random() < 0.5 else "") + (self.links(r.randint(2, 7)) if r.random() < 0.4 else "")
            tag = r.choice(("header", "header", "div"))
        elif kind == "menu":
            inside, tag = self.links(r.randint(3, 12)), r.choice(("nav", "nav", "div", "ul"))
        elif kind == "ad":
            inside = r.choice((self.words(2, 30), self.element("p", self.words(4, 30)), self.element("a", self.words(3, 14), ' href="/ad"'), self.element("h4", self.words(2, 6)) + self.element("p", self.words(5, 20))))
            tag = r.choice(("div", "div", "aside", "section", "ins"))
        elif kind == "notice":
            inside = self.element("p", self.words(8, 50)) + (self.element("button", self.words(1, 2)) if r.random() < 0.6 else "")
            inside, tag = (self.words(6, 30), "div") if r.random() < 0.3 else (inside, r.choice(("div", "section", "aside", "dialog")))
        elif kind == "sidebar":
            inside = "".join(self.element(r.choice(("h2", "h3", "h4")), self.words(1, 4)) + r.choice((self.links(r.randint(2, 8)), self.element("p", self.words(5, 40)))) for _ in range(r.randint(1, 3)))
            tag = r.choice(("aside", "aside", "div", "section"))
        elif kind == "comments":
            one = lambda: self.element(r.choice(("div", "li", "article")), self.element(r.choice(("span", "cite", "b", "h4")), self.words(1, 2)) + self.paragraph(False), self.name("comments"))
            inside = self.element("h3", self.words(1, 3)) + "".join(one() for _ in range(r.randint(1, 6)))
            if r.random() < 0.4:
                inside += self.aside("form")
            tag = r.choice(("section", "div", "div", "ol"))
        elif kind == "form":
            inside = self.element("label", self.words(1, 4)) + '<input name="q">' + r.choice(("", self.element("textarea", self.words(1, 5)), self.element("select", self.element("option", self.words(1, 2)) * 3))) + self.element("button", self.words(1, 2))
            inside = (self.element("p", self.words(4, 20)) if r.random() < 0.4 else "") + inside
            tag = r.choice(("form", "form", "form", "div"))
        elif kind == "share":
            inside, tag = self.links(r.randint(2, 5)), r.choice(("div", "ul", "p"))
        else:
            inside = r.choice(("&copy; ", "")) + self.words(2, 20) + (" &middot; " + self.words(3, 16) if r.random() < 0.6 else "") + (self.links(r.randint(2, 9)) if r.random() < 0.5 else "")
            inside = self.element("p", inside) if r.random() < 0.4 else inside
            tag = r.choice(("footer", "footer", "div"))
        return self.element(tag, inside, self.name(kind, 0.95 if tag in ("div", "section", "p", "ul", "ol") else 0.5))

    def main(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.85:
            title = self.element(r.choice(("h1", "h1", "h1", "h2")), self.words(2, 14), gold=True)
            parts.append(self.element("header", title, gold=True) if r.random() < 0.15 else title)
        for _ in range(r.choice((1, 1, 1, 2, 3, 4, 6, 9, 14))):
            parts.append(self.paragraph(True))
            x = r.random()
            if x < 0.08:
                parts.append(self.element(r.choice(("h2", "h3")), self.words(1, 7), gold=True))
            elif x < 0.14:
                parts.append(self.list_(True))
            elif x < 0.18:
                parts.append(self.element("blockquote", self.paragraph(True), gold=True))
            elif x < 0.21:
                parts.append(self.table())
            elif x < 0.24:
                parts.append(self.element("pre", self.words(4, 30), gold=True))
            elif x < 0.27:
                parts.append(self.element("figure", "<img src='z'>" + self.element("figcaption", self.words(3, 12), gold=True), gold=True))
            elif x < 0.36:
                parts.append(self.aside(r.choice(("ad", "ad", "share", "sidebar", "form", "notice"))))
        if r.random() < 0.1:
            parts.append(self.aside("comments"))
        if r.random() < 0.12:
            parts.append(self.aside("share"))
        inside = "".join(parts)
        if r.random() < 0.2:
            inside = self.element(r.choice(("div", "section")), inside, self.name("neutral"), gold=True)
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        return self.element(tag, inside, self.name("main", 0.9 if tag in ("div", "section") else 0.3), gold=True)

    def page(self) -> str:
        r = self.r
        top = [self.aside(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.8), ("form", 0.15), ("ad", 0.5)) if r.random() < p]
        r.shuffle(top)
        rest = [self.aside(k) for k, p in (("sidebar", 0.35), ("comments", 0.35), ("ad", 0.3), ("form", 0.2), ("sidebar", 0.2), ("share", 0.15)) if r.random() < p]
        r.shuffle(rest)
        middle = self.main() + "".join(rest)
        if r.random() < 0.2 and rest:
            middle = rest[0] + self.main() + "".join(rest[1:])
        if r.random() < 0.35:
            middle = self.element(r.choice(("div", "main", "section")), middle, self.name("neutral"))
        body = "".join(top) + middle + (self.aside("footer") if r.random() < 0.85 else "") + (self.aside("notice") if r.random() < 0.15 else "")
        if r.random() < 0.25:
            body = self.element("div", body, self.name("neutral"))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int, seed: int = 1) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
