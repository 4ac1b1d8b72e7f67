"""Labelled pages for html_tree.train(): layouts written here, filled with seeded words.

Elements carry gold="1" where they are the article and gold="0" where they are
not; what has no mark takes its parent's.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = "an ba ce do el fi ga hu in jo ka le mi no or pe ra si to un ve wa".split()


class _Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        return self.words(self.r.randint(low, high)).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def para(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8])))

    def links(self, n: int, sep: str = " ") -> str:
        return sep.join(f'<a href="/{self.words(1)}">{self.words(self.r.randint(1, 4))}</a>' for _ in range(n))

    def items(self, n: int) -> str:
        return "".join(f"<li>{self.links(1)}</li>" for _ in range(n))

    def body(self) -> str:
        r, out = self.r, []
        for k in range(r.choice([1, 2, 3, 5, 9, 14])):
            x = r.random()
            if x < 0.62:
                inner = self.para()
                if r.random() < 0.25:
                    inner += f" <a href='#'>{self.words(2)}</a> {self.sentence()}"
                if r.random() < 0.15:
                    inner = f"<b>{self.sentence(3, 8)}</b>" + r.choice(["", "<br>", " "]) + inner
                out.append(f"<p>{inner}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif x < 0.74:
                h = r.choice(["h2", "h3", "h4"])
                out.append(f"<{h}>{self.words(r.randint(1, 6)).capitalize()}</{h}>")
            elif x < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.sentence(2, 10)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{self.para()}</p></blockquote>")
            elif x < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.96:
                out.append(f"<figure><img src='x.jpg'><figcaption>{self.sentence(3, 9)}</figcaption></figure>")
            else:
                out.append(f"<pre>{self.words(6)}</pre>")
        return "".join(out)

    def inside(self) -> str:
        """What sits within an article's element without being the article."""
        r = self.r
        one = [
            lambda: f'<div class="{r.choice(["share", "social-share", "sharing-buttons", "post-share"])}" gold="0">{self.links(3)}</div>',
            lambda: f'<div class="{r.choice(["ad", "advert", "ad-slot", "sponsored", "promo-box", "ads"])}" gold="0">{self.sentence(3, 12)}</div>',
            lambda: f'<aside class="{r.choice(["related", "more-stories", "widget", "pullquote-ad"])}" gold="0"><h3>{self.words(2)}</h3><ul>{self.items(3)}</ul></aside>',
            lambda: f'<div class="{r.choice(["newsletter", "subscribe-box", "newsletter-signup", "paywall-notice"])}" gold="0"><p>{self.sentence()}</p><form><input name="q"><button>{self.words(2)}</button></form></div>',
            lambda: f'<section class="{r.choice(["comments", "comment-list", "reader-comments", "post-comments"])}" id="comments" gold="0"><h3>{self.words(2)}</h3>'
            + "".join(f'<div class="comment"><p>{self.para()}</p></div>' for _ in range(r.randint(1, 4)))
            + "</section>",
            lambda: f'<nav class="{r.choice(["toc", "pagination", "breadcrumbs", "post-nav"])}" gold="0">{self.links(3)}</nav>',
            lambda: f'<footer gold="0"><p>{r.choice(["Tags: ", "", "Filed under "])}{self.links(2)}</p></footer>',
        ]
        return r.choice(one)()

    def around(self, top: bool) -> str:
        """A piece of page furniture above or below the article."""
        r = self.r
        short = self.r.random() < 0.5
        one = [
            lambda: f"<nav gold='0'><ul>{self.items(r.randint(3, 8))}</ul></nav>",
            lambda: f"<header{r.choice(['', ' class=\"site-header\"', ' id=\"masthead\"'])} gold='0'><div class='logo'>{self.words(2)}</div><p>{self.sentence(2, 8)}</p><ul class='menu'>{self.items(4)}</ul></header>",
            lambda: f"<div class='{r.choice(['menu', 'navbar', 'main-nav', 'topnav', 'breadcrumb'])}' gold='0'>{self.links(5, r.choice([' | ', ' ', ' &raquo; ']))}</div>",
            lambda: f"<div class='{r.choice(['ad', 'ads', 'banner-ad', 'advertisement', 'ad-container', 'sponsor'])}' gold='0'>{self.sentence() if short else self.para()}</div>",
            lambda: f"<div class='{r.choice(['cookie-notice', 'cookie-banner', 'gdpr', 'consent', 'alert', 'site-notice', 'notification-bar'])}' gold='0'><p>{self.para()}</p><button>{self.words(1)}</button></div>",
            lambda: f"<form class='{r.choice(['search', 'login', 'signup'])}' gold='0'><label>{self.words(2)}</label><input><button>{self.words(1)}</button></form>",
            lambda: f"<aside{r.choice(['', ' class=\"sidebar\"', ' id=\"sidebar\"'])} gold='0'><h3>{self.words(2)}</h3><ul>{self.items(5)}</ul><p>{self.para()}</p></aside>",
            lambda: f"<div {r.choice(['class', 'id'])}='{r.choice(['sidebar', 'right-sidebar', 'side-bar', 'widget-area', 'related-posts', 'trending'])}' gold='0'><h4>{self.words(2)}</h4><p>{self.sentence()}</p><ul>{self.items(4)}</ul></div>",
            lambda: f"<footer gold='0'>&copy; {r.choice(['', '2024 '])}{self.words(2)} &middot; {self.sentence(2, 9)}</footer>",
            lambda: f"<footer gold='0'><p>{self.para()}</p><p>{self.links(4)}</p></footer>",
            lambda: f"<div {r.choice(['class', 'id'])}='{r.choice(['footer', 'site-footer', 'copyright', 'legal'])}' gold='0'><p>{self.para()}</p>{self.links(3, ' | ')}</div>",
            lambda: f"<section {r.choice(['class', 'id'])}='{r.choice(['comments', 'comments-area', 'disqus', 'discussion', 'responses comments'])}' gold='0'><h2>{self.words(2)}</h2>"
            + "".join(f"<{e} class='comment'><p>{self.para()}</p></{e}>" for e in [r.choice(["article", "div", "li"])] * r.randint(1, 4))
            + "</section>",
            lambda: f"<ul class='{r.choice(['menu', 'links', 'nav', 'social'])}' gold='0'>{self.items(5)}</ul>",
            lambda: f"<div gold='0'>{self.links(4, ' | ')}</div>",
            lambda: f"<p gold='0'>{self.links(2)}</p>",
        ]
        return r.choice(one[:8] if top else one[3:])()

    def page(self, bare: bool = False) -> str:
        r = self.r
        title = self.sentence(3, 9)
        before = "".join(self.around(True) for _ in range(r.randint(0, 4)))
        after = "".join(self.around(False) for _ in range(r.randint(0, 4)))
        body = self.body()
        parts = ["" if r.random() < 0.6 else self.inside() for _ in range(2)]
        head = f"<h1>{title}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.2:
            head = f"<header><h1>{title}</h1><p>{self.sentence(2, 6)}</p></header>"
        mid = head + (f"<p><b>{title}<br>" if r.random() < 0.3 else "") + body + parts[0] + (self.body() if parts[0] and r.random() < 0.5 else "") + parts[1]
        shape = r.choice(
            [
                "<article gold='1'>{}</article>", "<article gold='1'>{}</article>", "<article class='post' gold='1'><div class='entry-content'>{}</div></article>",
                "<main gold='1'>{}</main>", "<main gold='1'><article>{}</article></main>", "<div id='content' gold='1'>{}</div>", "<div class='article-body' gold='1'>{}</div>",
                "<div id='main'><div class='post-content' gold='1'>{}</div></div>", "<div class='container'><div class='story' gold='1'>{}</div></div>",
                "<section class='content' gold='1'>{}</section>", "<div gold='1'>{}</div>", "<div id='wrapper'><div gold='1'>{}</div></div>",
                "<table><tr><td gold='1'>{}</td></tr></table>", "<div class='row'><div class='col-8' gold='1'>{}</div></div>",
            ]
        ).format(mid)
        start = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        wrap = r.choice(["<body>{}</body></html>", "<body>{}</body></html>", "<body><div id='page'>{}</div></body></html>", "<body>{}"])
        if bare:  # no element around the article; paragraphs of other elements, or of none
            kind = r.randrange(3)
            shape = (mid, re.sub("<(/?)p>", r"<\1div>", mid), re.sub("</?p>", "<br>", mid))[kind]
            if kind < 2:
                shape = re.sub(r"<(p|div|h[1-6]|ul|blockquote|table|figure|pre|header)(?=[ >])(?![^>]*gold=)", r"<\1 gold='1'", shape)
            wrap = "<body gold='1'>{}</body></html>" if kind == 2 else r.choice(["<body>{}</body></html>", "{}"])
            start = start if wrap != "{}" or r.random() < 0.5 else ""
        return (start if r.random() < 0.9 else "") + wrap.format(before + shape + after)


def labelled_pages(n: int = 200, seed: int = 1, bare: bool = False) -> list[str]:
    """bare: pages whose article has no element of its own."""
    return [_Filler(seed * 100_003 + k).page(bare) for k in range(n)]
