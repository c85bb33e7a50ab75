"""Labelled pages that operator 2 learns from: pages put together by rule, of which we know what is content.

Their words mean nothing; layouts, class names and the way of writing are those that public pages commonly have.
"""

from __future__ import annotations

import random

# Names that pages commonly give to what is and what isn't content.
MAIN = "content main post article entry story body text page article-body post-content entry-content main-content story-body".split()
NOT = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar main-menu site-nav toc pagination pager".split(),
    "header": "header masthead banner site-header top logo".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget related recommended more-stories popular tags widget-area trending promo".split(),
    "ad": "ad ads advert advertisement sponsored sponsor banner-ad promo adsbox google-ad".split(),
    "notice": "cookie cookie-notice consent gdpr notice alert popup modal paywall subscribe newsletter notification disclaimer".split(),
    "form": "form login search newsletter-form signup comment-form contact-form subscribe".split(),
    "comments": "comments comment comment-list disqus responses discussion replies reader-comments".split(),
    "share": "share social share-buttons follow byline meta author-info".split(),
}
SYLLABLES = "ra ti no el an mor ue sta che lon vi er ous ta ken pra so in da".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.content = rng, set()

    def words(self, n: int) -> str:
        r = self.rng
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(0, n, r.randint(5, 14)):
            out[i] = out[i].capitalize()
            out[max(0, i - 1)] += r.choice([".", ".", ",", "!", "?"]) if i else ""
        if r.random() < 0.08:
            out = [w.upper() for w in out]
        if r.random() < 0.08:
            out = [w + r.choice(["###", "%%%", "!!", "***", "$$$"]) for w in out]
        return (" | " if self.rng.random() < 0.06 else " ").join(out)

    def sentence(self, low: int, high: int, stop: bool = True) -> str:
        return self.words(self.rng.randint(low, high)) + ("." if stop else "")

    def kept(self, text: str) -> str:
        self.content.add(" ".join(text.split()))
        return text

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.sentence(low, high, False)}</a>'

    def named(self, kind: str) -> str:
        r = self.rng
        if r.random() < 0.15:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{r.choice(NOT[kind])}"'

    def links(self, kind: str, n: int) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(n))
        return f"<ul{self.named(kind)}>{items}</ul>"

    def boilerplate(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            return self.rng.choice([f"<nav{self.named('nav')}>{self.links('nav', r.randint(2, 9))}</nav>", f"<div{self.named('nav') or ' class=menu'}>{self.links('nav', r.randint(2, 9))}</div>", f"<nav>{' | '.join(self.link() for _ in range(4))}</nav>"])
        if kind == "header":
            tag = r.choice(["header", "div"])
            return f"<{tag}{self.named('header') or ' class=header'}><p>{self.sentence(1, 5, False)}</p>{self.links('nav', r.randint(0, 5))}</{tag}>"
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            text = f"&copy; {r.randint(1999, 2030)} {self.sentence(1, 12)} &middot; {self.sentence(1, 18)}"
            return f"<{tag}{self.named('footer') if tag == 'footer' else ' class=footer'}>{r.choice([text, f'<p>{text}</p>' + self.links('nav', 3)])}</{tag}>"
        if kind == "aside":
            tag = r.choice(["aside", "div", "section"])
            name = self.named("aside") if tag == "aside" else f' class="{r.choice(NOT["aside"])}"'
            return f"<{tag}{name}><h3>{self.sentence(1, 4, False)}</h3>{self.links('aside', r.randint(1, 6))}<p>{self.sentence(4, 30)}</p></{tag}>"
        if kind == "form":
            return f"<form{self.named('form')} action=/x><label>{self.sentence(1, 4, False)}</label><input name=q><p>{self.sentence(3, 12)}</p><button>{self.sentence(1, 2, False)}</button></form>"
        if kind == "comments":
            tag, item = r.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article")])
            inner = "".join(f'<{item}{r.choice(["", self.named("comments")])}><p>{self.sentence(1, 3, False)}</p><p>{self.sentence(3, 45)}</p></{item}>' for _ in range(r.randint(1, 5)))
            return f'<{tag} class="{r.choice(NOT["comments"])}"><h3>{self.sentence(1, 3, False)}</h3>{inner}</{tag}>'
        text = self.sentence(2, 25)
        tag = r.choice(["div", "div", "section", "p"] if kind != "share" else ["div", "ul", "p"])
        inner = text if tag == "p" or r.random() < 0.6 else f"<p>{text}</p>" + (self.link() if r.random() < 0.4 else "")
        return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(NOT[kind])}">{inner}</{tag}>'

    def block(self) -> str:
        r, x = self.rng, self.rng.random()
        text = self.sentence(1, 5, r.random() < 0.4) if r.random() < 0.3 else self.sentence(8, 120)
        if x < 0.7:
            whole = text
            if r.random() < 0.2:
                extra = self.words(2)
                whole = f"{text} {extra}"
                shown = f'{text} <a href="/y">{extra}</a>'
            else:
                shown = r.choice([text, text, f"<b>{text}<br>", f"<span>{text}</span>"])
            self.kept(whole)
            return f"<p>{shown}" + r.choice(["</p>", "</p>", "</p>", ""])
        if x < 0.8:
            return f"<h{(k := r.randint(2, 4))}>{self.kept(self.sentence(1, 8, False))}</h{k}>"
        if x < 0.87:
            items = "".join(f"<li>{self.kept(self.sentence(2, 25))}</li>" for _ in range(r.randint(1, 5)))
            return f"<ul>{items}</ul>"
        if x < 0.92:
            return f"<blockquote><p>{self.kept(text)}</p></blockquote>"
        if x < 0.95:
            return f"<pre>{self.kept(self.sentence(4, 30))}</pre>"
        cells = "".join(f"<tr><td>{self.kept(self.sentence(1, 4, False))}</td><td>{self.kept(self.sentence(1, 6, False))}</td></tr>" for _ in range(2))
        return f"<table>{cells}</table>"

    def whole(self) -> tuple[str, set[str]]:
        r = self.rng
        blocks = [f"<h1>{self.kept(self.sentence(1, 12, False))}</h1>"] if r.random() < 0.85 else []
        blocks += [self.block() for _ in range(r.choice([0, 1, 1, 2, 4, 8, 14]))]
        if not blocks:
            blocks = [f"<p>{self.kept(self.sentence(1, 30))}</p>"]
        for kind in ("ad", "share", "aside", "notice", "form"):
            if r.random() < 0.15:
                blocks.insert(r.randint(0, len(blocks)), self.boilerplate(kind))
        if r.random() < 0.1:
            blocks.append(self.boilerplate("comments"))
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        name = f' class="{r.choice(MAIN)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        body = f"<{tag}{name}>{''.join(blocks)}</{tag}>"
        if r.random() < 0.3:
            body = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{body}</div>"
        before = [self.boilerplate(k) for k in ("header", "nav", "ad", "notice") if r.random() < 0.55]
        after = [self.boilerplate(k) for k in ("aside", "comments", "form", "share", "ad", "footer") if r.random() < 0.45]
        if r.random() < 0.2:
            body = f"<div class=row>{body}{self.boilerplate('aside')}</div>"
        if r.random() < 0.15:
            return f"<html><head><title>{self.words(4)}</title></head><body>{self.in_table(''.join(blocks))}</body></html>", self.content
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", self.content


    def in_table(self, blocks: str) -> str:
        """An old way of laying pages out: menus, article and footer are cells."""
        r = self.rng
        top = r.choice([" | ", " - ", " ", "<br>"]).join(self.link(1, 3) for _ in range(r.randint(2, 8)))
        head = r.choice(["", f"<b>{self.sentence(1, 3, False)}</b><br>", f"<h3>{self.sentence(1, 3, False)}</h3>"])
        side = head + "<br>".join(self.link(1, 4) for _ in range(r.randint(2, 9)))
        foot = r.choice([f"<small>&copy; {r.randint(1995, 2020)} {self.sentence(1, 6, False)}</small>", f"{self.sentence(1, 5, False)} {r.randint(1995, 2020)}", f"<p>{self.sentence(2, 9)}</p>"])
        main = r.choice(["", "", f" class={r.choice(MAIN).split()[0]}", " valign=top"])
        cells = [f"<td{r.choice(['', ' class=left', ' class=menu', ' width=150'])}>{side}</td>", f"<td{main}>{blocks}</td>"]
        if r.random() < 0.3:
            cells.reverse()
        rows = [f"<tr><td colspan=2{r.choice(['', self.named('header')])}>{top}</td></tr>" if r.random() < 0.8 else "", f"<tr>{''.join(cells)}</tr>", f"<tr><td colspan=2{r.choice([' class=footer', ' class=copyright', self.named('footer')])}>{foot}</td></tr>" if r.random() < 0.8 else ""]
        return f"<table width=100%>{''.join(rows)}</table>"


def labelled_pages(n: int = 500, seed: int = 2) -> list[tuple[str, set[str]]]:
    """(html, texts of its content runs)."""
    rng = random.Random(seed)
    return [_Page(rng).whole() for _ in range(n)]
