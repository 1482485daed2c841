"""Pages of a second kind, whose layouts are written by hand and have nothing to do with those that the extractor is fitted on."""

from __future__ import annotations

import random
from collections.abc import Iterator

WORDS = "the a river town council report said on after new people water between years small house market found over north under light story where most began small road field open winter school local group public plan work week early late next first second many few some still across along south evening morning company letter history garden window paper station".split()


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def line(self, least: int = 2, most: int = 6) -> str:
        return " ".join(self.r.choices(WORDS, k=self.r.randint(least, most))).capitalize()

    def para(self) -> str:
        return " ".join(f"{self.line(5, 16)}{self.r.choice([', ' + self.line(3, 7).lower() + '.', '.', '.', '?'])}" for _ in range(self.r.randint(2, 7)))

    def list_of(self, n: int, pattern: str) -> str:
        return "".join(pattern.format(self.line(1, 4)) for _ in range(n))


def blog(w: Writer) -> tuple[str, list[str]]:
    title, body = w.line(4, 9), [w.para() for _ in range(w.r.randint(3, 9))]
    comments = "".join(f"<li class='comment even thread-{i}'><cite>{w.line(1, 2)}</cite> says:<p>{w.para()}</p><a href=#r>Reply</a></li>" for i in range(w.r.randint(0, 5)))
    return f"""<html><head><title>{title} | A blog</title><style>.a{{}}</style></head><body class="single postid-9"><div id=page><div id=masthead role=banner><p class=site-title><a href=/>{w.line(2, 3)}</a></p><p class=site-description>{w.line(4, 8)}</p></div>
<div id=access role=navigation><div class=menu><ul>{w.list_of(6, "<li class=page_item><a href=/p>{}</a></li>")}</ul></div></div>
<div id=main><div id=container><div id=content role=main><div id=nav-above class=navigation><a href=/o>&larr; {w.line()}</a></div>
<div class="post-9 post type-post hentry"><h1 class=entry-title>{title}</h1><div class=entry-content><p>{"</p><p>".join(body)}</p></div></div>
<div id=comments><h3>{len(comments)} responses</h3><ol class=commentlist>{comments}</ol><div id=respond><h3>Leave a Reply</h3><form action=/c><p>Your email address will not be published.<textarea>Type</textarea><input type=submit></form></div></div></div></div>
<div id=primary class=widget-area><ul><li class="widget_recent"><h3>Recent Posts</h3><ul>{w.list_of(5, "<li><a href=/r>{}</a></li>")}</ul></li></ul></div></div><div id=colophon>Proudly powered by a blog engine.</div></div></body></html>""", [title, *body]


def news(w: Writer) -> tuple[str, list[str]]:
    title, lead, body = w.line(5, 10), w.para(), [w.para() for _ in range(w.r.randint(4, 12))]
    cut = len(body) // 2
    return f"""<!doctype html><html><body><div class="cookie-consent-banner"><p>We use cookies. By browsing you agree.</p><button>Accept</button></div><header class="site-header"><a href="/">Daily</a><nav><a href=/1>{w.line(1, 1)}</a><a href=/2>{w.line(1, 1)}</a><a href=/3>{w.line(1, 1)}</a></nav></header>
<main><article class="story"><h1 class="headline">{title}</h1><p class="standfirst">{lead}</p><section class="story-body">{"".join(f"<p>{p}</p>" for p in body[:cut])}<aside class="related-inline"><h4>Read more</h4><ul>{w.list_of(3, "<li><a href=/m>{}</a></li>")}</ul></aside><div class="advert mpu">Advertisement</div>{"".join(f"<p>{p}</p>" for p in body[cut:])}</section></article></main>
<section class="most-read"><h2>Most read</h2><ol>{w.list_of(8, "<li><a href=/t>{}</a></li>")}</ol></section><footer><p>Copyright. All rights reserved.</p><ul>{w.list_of(4, "<li><a href=/f>{}</a></li>")}</ul></footer></body></html>""", [title, lead, *body]


def table_layout(w: Writer) -> tuple[str, list[str]]:
    title, body = w.line(3, 6), [w.para() for _ in range(w.r.randint(3, 8))]
    return f"""<HTML><BODY BGCOLOR=#FFFFFF><TABLE WIDTH=100%><TR><TD COLSPAN=3><A HREF=/>{w.line(1, 2)}</A> | <A HREF=/a>{w.line(1, 2)}</A> | <A HREF=/b>{w.line(1, 2)}</A></TD></TR>
<TR><TD WIDTH=120>{w.list_of(7, "<A HREF=/x>{}</A><BR>")}</TD><TD><FONT SIZE=+2>{title}</FONT><P>{"<P>".join(body)}</TD><TD WIDTH=100><IMG SRC=x.gif><BR><A HREF=/ad>{w.line(1, 2)}</A></TD></TR><TR><TD COLSPAN=3><CENTER><SMALL>&copy; 1999 <A HREF=mailto:x>webmaster</A></SMALL></CENTER></TD></TR></TABLE></BODY></HTML>""", [title, *body]


def docs(w: Writer) -> tuple[str, list[str]]:
    title, parts, out = w.line(2, 4), [], []
    for _ in range(w.r.randint(2, 5)):
        head, text, items = w.line(2, 4), w.para(), [w.line(4, 9) for _ in range(3)]
        code = f"{w.line(1, 2).lower()} = call(x)"
        out += [head, text, *items, code]
        parts.append(f"<h2 id=s>{head}</h2><p>{text}</p><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul><pre><code>{code}</code></pre>")
    return f"""<!DOCTYPE html><html><body><div class="topbar"><a href=/>Docs</a><form role=search><input placeholder=Search></form></div><div class="sidebar"><div class="toctree"><ul>{w.list_of(12, "<li class=toctree-l1><a href=/d>{}</a></li>")}</ul></div></div>
<div class="document"><div class="documentwrapper"><div class="body" role="main"><h1>{title}</h1>{"".join(parts)}</div></div></div><div class="footer">&copy; The authors. Built with a generator.</div></body></html>""", [title, *out]


def plain(w: Writer) -> tuple[str, list[str]]:
    title, body = w.line(3, 7), [w.para() for _ in range(w.r.randint(4, 10))]
    return f"""<div class="c1"><div class="c2">{w.list_of(5, "<a href=/q>{}</a> ")}</div><div class="c3"><div class="c4"><div class="c5">{title}</div>{"".join(f'<div class="c6">{p}</div>' for p in body)}</div></div><div class="c7">{w.list_of(6, "<div><a href=/z>{}</a></div>")}</div><div class="c8">Terms Privacy Contact</div></div>""", [title, *body]


def wiki(w: Writer) -> tuple[str, list[str]]:
    title, body = w.line(1, 3), [w.para() for _ in range(w.r.randint(4, 9))]
    linked = [p.replace(p.split()[3], f"<a href=/w>{p.split()[3]}</a>", 1) for p in body]
    return f"""<html><body><div id=content class=mw-body role=main><h1 id=firstHeading>{title}</h1><div id=bodyContent><div id=mw-content-text><div class=mw-parser-output><p>{"</p><p>".join(linked)}</p></div></div><div id=catlinks class=catlinks><a href=/c>Categories</a>: <ul>{w.list_of(3, "<li><a href=/k>{}</a></li>")}</ul></div></div></div>
<div id=mw-navigation><h2>Navigation menu</h2><div id=p-personal role=navigation><ul>{w.list_of(4, "<li><a href=/u>{}</a></li>")}</ul></div><div id=p-tb role=navigation><h3>Tools</h3><ul>{w.list_of(6, "<li><a href=/s>{}</a></li>")}</ul></div></div><div id=footer role=contentinfo><ul><li>This page was last edited long ago.</li></ul></div></body></html>""", [title, *body]


KINDS = (blog, news, table_layout, docs, plain, wiki)


def pages(n: int, seed: int = 0) -> Iterator[tuple[str, str, list[str]]]:
    """(kind, html, blocks of main text)"""
    w = Writer(seed)
    for i in range(n):
        kind = KINDS[i % len(KINDS)]
        yield (kind.__name__, *kind(w))
