"""Made-up web pages with known main text, to fit the extractor on.

Layouts vary in the element or attribute that marks the article, in what stands around and within it
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments, share links), in its
length and in how tidy the markup is. Every fourth page tells nothing by its elements or names: tables or bare
boxes, where only the text itself, links and place speak. The same seed gives the same pages.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "an ber con del er fo ga hin is ju ka lo mer no or pa qui re so ta un ver wi xo ya ze".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.main: list[str] = []
        self.n = 0

    def words(self, n: int, caps: float = 0.02) -> str:
        out = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)]
        return " ".join(w.upper() if self.r.random() < caps else w for w in out)

    def prose(self, n: int) -> str:
        style, out = self.r.choice(["plain", "plain", "plain", "pipes", "shout", "marks", "short"]), []
        while n > 0:
            k = self.r.randint(1, 18)
            s = self.words(k).capitalize()
            out.append({"pipes": s.replace(" ", " | "), "shout": s.upper().replace(" ", "!! "), "marks": s.replace(" ", "### ")}.get(style, s) + self.r.choice([".", ".", "!", "?", ","]))
            n -= k
        return " ".join(out)

    def mark(self, text: str) -> str:
        """Main text, named so that it is found again."""
        self.n += 1
        name = f"qz{self.n}zq"
        self.main.append(name)
        return f"{text} {name}"

    def attr(self, *names: str) -> str:
        kind = self.r.choice(["class", "id", "class", "none"])
        return "" if kind == "none" else f' {kind}="{self.r.choice(names)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.words(1)}">{self.words(self.r.randint(1, 4))}</a></li>' for _ in range(n))

    def menu(self) -> str:
        items = f"<ul>{self.links(self.r.randint(2, 12))}</ul>"
        return self.r.choice([f"<nav>{items}</nav>", f"<nav{self.attr('menu', 'navbar')}>{items}</nav>", f'<div class="{self.r.choice(["nav", "menu", "main-menu", "breadcrumbs"])}">{items}</div>', f'<div role="navigation">{items}</div>'])

    def header(self) -> str:
        inner = f"<h1>{self.words(3)}</h1><p>{self.words(self.r.randint(3, 12))}</p>" if self.r.random() < 0.5 else f"<a href='/'>{self.words(2)}</a>"
        return self.r.choice([f"<header>{inner}{self.menu() if self.r.random() < 0.4 else ''}</header>", f'<div class="{self.r.choice(["header", "masthead", "site-header", "banner"])}">{inner}</div>'])

    def footer(self) -> str:
        text = self.r.choice([f"&copy; 2024 {self.words(3)}", f"&copy; {self.words(1)}.example.com &middot; {self.prose(self.r.randint(4, 40))}", self.prose(self.r.randint(5, 40))])
        return self.r.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul>{self.links(4)}</ul></footer>", f'<div class="{self.r.choice(["footer", "site-footer", "copyright"])}"><p>{text}</p></div>'])

    def side(self) -> str:
        inner = f"<h3>{self.words(2)}</h3><ul>{self.links(self.r.randint(2, 8))}</ul>" if self.r.random() < 0.6 else f"<p>{self.prose(self.r.randint(10, 60))}</p>"
        return self.r.choice([f"<aside>{inner}</aside>", f'<div class="{self.r.choice(["sidebar", "side", "related", "widget", "trending"])}">{inner}</div>', f'<section class="{self.r.choice(["related-posts", "recommended"])}">{inner}</section>'])

    def advert(self) -> str:
        text = self.prose(self.r.randint(2, 60))
        lines = text if self.r.random() < 0.6 else f"<p>{text}</p>"
        return f'<!-- ad {self.n} --><div {self.r.choice(["class", "id"])}="{self.r.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-slot"])}">{lines}</div>'

    def notice(self) -> str:
        name = self.r.choice(["cookie-notice", "consent", "notice", "gdpr-banner", "newsletter", "subscribe", "popup", "alert"])
        return f'<{(t := self.r.choice(["div", "section", "aside"]))} {self.r.choice(["class", "id"])}="{name}"><p>{self.prose(self.r.randint(5, 40))}</p>{"<button>OK</button>" if self.r.random() < 0.5 else ""}</{t}>'

    def form(self) -> str:
        inner = f'<form action="/q"{self.attr("search", "login-form")}><label>{self.words(2)}</label><input name="q"><p>{self.words(self.r.randint(2, 12))}</p><button>Go</button></form>'
        return f'<div class="{self.r.choice(["respond", "reply-form", "search-box"])}"><h3>{self.words(3)}</h3>{inner}</div>' if self.r.random() < 0.3 else inner

    def comments(self) -> str:
        one = lambda: f'<{(t := self.r.choice(["div", "li", "article"]))} class="{self.r.choice(["comment", "reply", "comment-body"])}"><p>{self.prose(self.r.randint(4, 80))}</p></{t}>'
        return f'<{(t := self.r.choice(["section", "div"]))} {self.r.choice(["class", "id"])}="{self.r.choice(["comments", "reader-comments", "discussion", "disqus_thread", "comment-list"])}"><h2>{self.words(1)}</h2>{"".join(one() for _ in range(self.r.randint(1, 6)))}</{t}>'

    def share(self) -> str:
        name = self.r.choice(["share", "social-links", "tags", "categories", "pagination", "byline"])
        return f'<div class="{name}">{self.words(1)}: <ul>{self.links(self.r.randint(1, 5))}</ul></div>' if self.r.random() < 0.6 else f'<div class="{name}"><a href="/">{self.words(2)}</a></div>'

    def junk(self) -> str:
        return self.r.choice([self.side, self.advert, self.advert, self.notice, self.form, self.share, self.menu])()

    def article(self) -> str:
        size = self.r.choice([1, 1, 2, 4, 8, 16])
        parts = [f"<h1>{self.mark(self.words(self.r.randint(1, 9)))}</h1>"] if self.r.random() < 0.8 else []
        for k in range(size):
            text = self.mark(self.prose(self.r.choice([1, 3, 10, 30, 80, 200])))
            if self.r.random() < 0.1:
                text = text.replace(" ", f' <a href="/{self.words(1)}">{self.words(1)}</a> ', 1)
            parts.append(self.r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<h2>{self.mark(self.words(3))}</h2><p>{text}</p>", f"<blockquote>{text}</blockquote>", f"<div>{text}</div>"]))
            if self.r.random() < 0.08:
                parts.append("<ul>" + "".join(f"<li>{self.mark(self.words(self.r.randint(1, 12)))}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            if self.r.random() < 0.08:
                parts.append(self.r.choice([self.advert, self.notice, self.share, self.side])())
        inner = "".join(parts)
        name = self.r.choice(["content", "post", "entry-content", "article-body", "story", "main-text"])
        shape = self.r.choice(["article", "article", "article", "main", "div", "both", "section"])
        return {"article": f"<article{self.attr('post', 'story')}>{inner}</article>", "main": f"<main>{inner}</main>", "div": f'<div {self.r.choice(["class", "id"])}="{name}">{inner}</div>', "both": f'<main><article><div class="{name}">{inner}</div></article></main>', "section": f'<section class="{name}">{inner}</section>'}[shape]

    def box(self, inner: str) -> str:
        """An element that says nothing of what it holds."""
        name = self.r.choice(["", "", f' class="{self.words(1)}{self.n}"', f' id="x{self.r.randint(1, 99)}"', f' class="col-{self.r.randint(1, 12)}"'])
        return f"<div{name}>{inner}</div>"

    def loose_links(self) -> str:
        one = lambda: f'<a href="/{self.words(1)}">{self.words(self.r.randint(1, 4))}</a>'
        gap = self.r.choice([" | ", "<br>", " ", "</div><div>", "</li><li>"])
        return gap.join(one() for _ in range(self.r.randint(1, 9)))

    def bare_article(self) -> str:
        size, kind = self.r.choice([2, 3, 5, 9, 14]), self.r.choice(["p", "p", "open p", "div", "br"])
        title = self.mark(self.words(self.r.randint(2, 8)))
        out = [self.r.choice([f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<div>{title}</div>", f"<font size=+2>{title}</font><p>", f"<b>{title}</b><p>"])]
        for _ in range(size):
            text = self.mark(self.prose(self.r.choice([10, 30, 60, 120])))
            if self.r.random() < 0.2:
                text = text.replace(" ", f' <a href="/{self.words(1)}">{self.words(1)}</a> ', 1)
            out.append({"p": f"<p>{text}</p>", "open p": f"<p>{text}", "div": self.box(text), "br": f"{text}<br><br>"}[kind])
        return "".join(out)

    def bare(self) -> str:
        links, small = self.loose_links, lambda: self.words(self.r.randint(1, 8))
        around = lambda: self.r.choice([links, links, links, small])()
        if self.r.random() < 0.5:
            cell = lambda x: f"<td{self.r.choice(['', ' width=120', ' valign=top'])}>{x}</td>"
            sides = [cell(around()) for _ in range(self.r.randint(0, 2))]
            sides.insert(self.r.randint(0, len(sides)), cell(self.bare_article()))
            rows = [cell(around())] * (self.r.random() < 0.7) + ["".join(sides)] + [cell(f"<center><small>&copy; {around()}</small></center>")] * (self.r.random() < 0.7)
            return "<table>" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>"
        parts = [self.box(around()) for _ in range(self.r.randint(0, 2))]
        article = self.box(self.bare_article())
        parts.append(self.box(article) if self.r.random() < 0.5 else article)
        parts += [self.box(around()) for _ in range(self.r.randint(0, 3))]
        return self.box("".join(parts)) if self.r.random() < 0.3 else "".join(parts)

    def page(self) -> str:
        if self.r.random() < 0.25:
            return f"<html><head><title>{self.words(4)}</title></head><body>{self.bare()}</body></html>"
        some = lambda f, p: f() if self.r.random() < p else ""
        top = [some(self.header, 0.5), some(self.menu, 0.7), some(self.notice, 0.3), some(self.advert, 0.5), some(self.form, 0.2), some(self.side, 0.2)]
        low = [some(self.comments, 0.4), some(self.side, 0.4), some(self.share, 0.2), some(self.advert, 0.3), some(self.form, 0.2), some(self.junk, 0.2)]
        self.r.shuffle(low)
        if self.r.random() < 0.3:
            self.r.shuffle(top)
        body = "".join(top) + self.article() + "".join(low) + some(self.footer, 0.8) + some(self.notice, 0.1)
        if self.r.random() < 0.4:
            body = f'<div{self.attr("page", "wrapper", "container", "layout")}>{body}</div>'
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(5)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}{"</body></html>" if self.r.random() < 0.9 else ""}'


def pages(count: int = 900, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, names within the main text's blocks)."""
    for k in range(count):
        m = Maker(seed * 100_003 + k)
        yield m.page(), [f"{x}" for x in m.main]
