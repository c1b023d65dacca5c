"""Made-up pages for the block labeller to learn from: eight families of layouts, each with its own way to mark the parts of a page.

`made_page(rng, family)` gives html in which every text of the article holds MARK, a private-use character that the parser's caller takes
out again, so that a block's label needs no counting. What the parts hold (menus, adverts, forms, comments, paragraphs, lists, tables)
is drawn from the same grammar in all families; how they are wrapped, named and ordered isn't. A family can be left out of training, to
measure how well the labeller reads layouts it has never seen.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

MARK = "\ue000"
FAMILIES = ("semantic", "named", "grid", "table", "sections", "opaque", "bare", "app")
KINDS = ("nav", "header", "footer", "aside", "notice", "ad", "form", "comments")

_SYLLABLES = "an ba co de el fi gu ha in jo ka lu mi no or pe qua re st ti un ver wi xa yo zen ch é ü ñ ß ation ment lich ung ción ou th er".split()
#: Words that the parts of a page often say, in languages the pages may be in.
_SAID = {
    "nav": "Home About Contact News Blog Products Services Login Archive Start Accueil Inicio Über Startseite Menu World Sports Weather Help FAQ",
    "header": "Welcome Daily Journal Times Portal Magazine The Site Official Menu Search",
    "footer": "Copyright © 2019 2021 2024 All rights reserved Privacy Terms Imprint Impressum Datenschutz Contact Mentions légales Powered by Alle Rechte vorbehalten Sitemap",
    "aside": "Related Popular Trending More Latest Archives Tags Categories Follow Recommended Most read Also Share Recent posts Siehe auch",
    "notice": "We use cookies Accept Decline Settings This site uses cookies By continuing you agree Wir verwenden Maintenance Breaking Please update",
    "ad": "Advertisement Sponsored Anzeige Publicité Publicidad Buy now Offer Sale Promoted Partner Free shipping Click here",
    "form": "Email Name Subscribe Newsletter Search Send Submit Password Sign up Message Country Your Register Suche Rechercher",
    "comments": "Reply says wrote ago Comments Like Report Permalink Commentaires Antworten Responses Log in to reply Kommentare Comentarios hours",
}
_MAIN_NAMES = "content article-body entry-content post story-body text body-copy article__body main-text prose page-content rich-text leftcol article-content single-post news-text post-body maincontent story detail".split()
_NAMES = {
    "nav": "menu main-menu navbar site-nav navigation breadcrumb breadcrumbs topnav nav-bar links pagination tabs global-nav menubar",
    "header": "header masthead site-header topbar branding logo-area top banner-top page-header",
    "footer": "footer site-footer copyright bottom colophon page-footer legal foot credits",
    "aside": "sidebar related widget related-posts side rightcol recommended tags share-bar author-box more-stories teaser-list rail",
    "notice": "cookie-banner notice alert consent gdpr banner message-bar infobox announcement popup",
    "ad": "ad ads advert sponsor promo adslot advertisement commercial partner-box teaser-ad banner-ad",
    "form": "search newsletter subscribe signup contact-form login-box searchbox form-wrap",
    "comments": "comments comment-list commentlist responses discussion reader-comments thread replies disqus",
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "notice": "section", "ad": "aside", "form": "form", "comments": "section"}


class Page:
    """One page in the making."""

    def __init__(self, rng: random.Random, family: str) -> None:
        self.rng, self.family, self.html = rng, family, []
        self.vocabulary = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(150)]
        # Pages by careless hands leave end tags out; texts may be odd throughout: shouted, strewn with signs, stuck on a word.
        self.sloppy = rng.choice((0, 0, 0.02, 0.3))
        self.quirk = rng.choice(("none",) * 7 + ("shout", "signs", "signs", "stuck", "split"))
        self.signs = ["".join(rng.choice(string.punctuation) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))]
        self.opaque = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(4, 8))) for _ in range(12)]
        self.named = family in ("semantic", "named", "app") or rng.random() < 0.5

    def add(self, *parts: str) -> None:
        self.html.extend(parts)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def end(self, tag: str) -> str:
        return "" if self.chance(self.sloppy) else f"</{tag}>"

    def words(self, n: int, odd: bool = True) -> str:
        rng, out = self.rng, [self.rng.choice(self.vocabulary) for _ in range(n)]
        quirk = self.quirk if odd and rng.random() < 0.9 else "none"
        if quirk == "shout":
            return f"{rng.choice(self.signs)} ".join(out).upper() if rng.random() < 0.7 else " ".join(out).upper()
        if quirk == "signs":
            return escaped(" ".join(w + rng.choice([*self.signs, ""]) for w in out))
        if quirk == "stuck":
            return " ".join([out[0]] * n if rng.random() < 0.5 else out)
        return (f" {escaped(self.signs[0])} " if quirk == "split" else " ").join(out)

    def sentence(self, n: int) -> str:
        out = self.words(n)
        return out[:1].upper() + out[1:] + self.rng.choice((".", ".", ".", ".", ".", ".", "!", "?", "", ",", ":"))

    def prose(self, most: int = 6) -> str:
        out = [self.sentence(self.rng.randint(1, 18)) for _ in range(self.rng.randint(1, most))]
        if self.chance(0.15):
            out.insert(self.rng.randrange(len(out) + 1), f'<a href="/{self.words(1, False)}">{self.words(self.rng.randint(1, 4))}</a>')
        if self.chance(0.1):
            tag = self.rng.choice(("b", "i", "em", "strong", "code", "span", "sup", "mark", "math"))
            out.append(f"<{tag}>{self.words(self.rng.randint(1, 4))}</{tag}>")
        return " ".join(out)

    def said(self, kind: str) -> str:
        rng, own = self.rng, _SAID[kind].split()
        begin = rng.randrange(len(own))
        usual = " ".join(own[begin : begin + rng.randint(1, 5)])
        free = rng.choice((self.words(rng.randint(1, 4), self.chance(0.3)), self.sentence(rng.randint(3, 14))))
        return rng.choice((usual, usual + " " + free, free, free))

    def link(self, text: str) -> str:
        return f'<a href="/{self.words(1, False)}">{text}</a>'

    def names(self, kind: str) -> str:
        """The attributes of a part's tag in this family."""
        rng = self.rng
        if self.family == "opaque":
            return rng.choice((f' class="css-{rng.choice(self.opaque)}"', f' class="{rng.choice(self.opaque)} {rng.choice(self.opaque)}"', f' id="{rng.choice(self.opaque)}"', ""))
        if not self.named or self.family in ("table", "bare"):
            return ""
        own = rng.choice(_MAIN_NAMES if kind == "main" else _NAMES[kind].split())
        if kind != "main" and self.chance(0.2):
            own = rng.choice((kind, f"{own} {rng.choice(('clearfix', 'block', 'hidden-print', 'dark', 'inner'))}"))
        return rng.choice((f' class="{own}"', f' class="{own}"', f' id="{own}"'))

    def idle(self) -> str:
        """Names without a meaning for the kind of a part: made-up ones."""
        return " ".join(self.rng.choice(self.vocabulary) + self.rng.choice(("", "", "-x", f"-{self.rng.randint(1, 12)}", "__in")) for _ in range(self.rng.randint(1, 2)))

    def wrap(self, kind: str) -> tuple[str, str]:
        """How a part of the page begins and ends."""
        rng, names = self.rng, self.names(kind)
        if self.family not in ("table", "bare"):  # names that say nothing stand beside those that do, or alone
            if names and self.chance(0.3):
                names = f'{names[:-1]} {self.idle()}"'
            elif not names and self.chance(0.5):
                names = f' class="{self.idle()}"'
        tag = "div"
        if self.family == "semantic":
            tag = rng.choice(("article", "article", "article", "main", "main", "section", "div")) if kind == "main" else rng.choice((_TAGS[kind], _TAGS[kind], "div"))
            names = names if self.chance(0.5) else ""
        elif self.family == "sections":
            tag = "section"
        elif self.family == "app":
            stem = {"main": rng.choice(("main", "article", "reader", "view"))}.get(kind, kind)
            tag = rng.choice((f"x-{stem}", f"app-{stem}", "div"))
            names += rng.choice(("", f' role="{rng.choice(("main", "article"))}"' if kind == "main" else f' role="{rng.choice(("navigation", "banner", "complementary", "contentinfo", "region"))}"'))
            n = rng.randint(0, 4)
            return f"<{tag}{names}>" + "<div>" * n, "</div>" * n + f"</{tag}>"
        elif self.family == "grid":
            outer = rng.choice(("row", "container", "grid", "columns"))
            inner = rng.choice((f"col-md-{rng.randint(2, 12)}", f"col-{rng.randint(1, 12)}", "col", "column", "cell"))
            return f'<div class="{outer}"><div class="{inner}"><div{names}>', "</div></div></div>"
        elif self.family == "bare":
            return ("", rng.choice(("", "", "<hr>", "<br>"))) if kind in ("main", "comments") or self.chance(0.7) else ("<div>", "</div>")
        elif self.family == "table":
            look = rng.choice(("", ' width="160"', ' valign="top"', ' bgcolor="#eeeeee"', ' colspan="2"'))
            return f"<td{look}>", self.end("td")
        elif kind in ("form",) and self.chance(0.6):
            tag = "form"
        return f"<{tag}{names}>", f"</{tag}>"

    # What the parts hold.

    def several(self, texts: list[str]) -> None:
        """Short texts as a list, a line of links, paragraphs or cells."""
        how = self.rng.choice(("ul", "ul", "ul", "line", "line", "p", "br", "dl", "div", "ol"))
        if how in ("ul", "ol"):
            self.add(f"<{how}>", *(f"<li>{t}{self.end('li')}" for t in texts), f"</{how}>")
        elif how == "line":
            between = self.rng.choice((" | ", " ", " &middot; ", " / ", " &raquo; ", "&nbsp;"))
            tag = self.rng.choice(("p", "div", "center", ""))
            self.add(f"<{tag}>" if tag else "", between.join(texts), f"</{tag}>" if tag else "")
        elif how == "br":
            self.add("<br>".join(texts))
        elif how == "dl":
            self.add("<dl>", *(f"<dd>{t}{self.end('dd')}" for t in texts), "</dl>")
        else:
            self.add(*(f"<{how}>{t}</{how}>" for t in texts))

    def part(self, kind: str) -> None:
        """A part that isn't the article."""
        rng = self.rng
        begin, end = self.wrap(kind)
        self.add(begin)
        if kind == "nav":
            self.several([self.link(self.said(kind) if self.chance(0.4) else self.words(rng.randint(1, 3), self.chance(0.3))) for _ in range(rng.randint(1, 12))])
        elif kind == "header":
            self.add(rng.choice((f"<h1>{self.said(kind)}</h1>", f"<div>{self.link(self.said(kind))}</div>", f"<p>{self.said(kind)}</p>", f"<img src=x alt=y>{self.said(kind)}", f"<h2>{self.words(2)}</h2><p>{self.said(kind)}</p>")))
            if self.chance(0.4):
                self.several([self.link(self.said("nav")) for _ in range(rng.randint(1, 5))])
        elif kind == "footer":
            for _ in range(rng.randint(1, 3)):
                if self.chance(0.4):
                    self.several([self.link(self.said(kind)) for _ in range(rng.randint(1, 6))])
                else:
                    tag = rng.choice(("p", "small", "div", "address", "center", "span", "", "", ""))
                    text = rng.choice(("&copy; ", "", "", "")) + rng.choice((self.said(kind), f"{self.words(1, False)}.{self.words(1, False)} {rng.randint(1990, 2030)}", self.sentence(rng.randint(1, 25)), self.prose(3)))
                    self.add(f"<{tag}>{text}</{tag}>" if tag else text)
        elif kind == "aside":
            if self.chance(0.6):
                self.add(f"<h{(k := rng.randint(2, 5))}>{self.said(kind)}</h{k}>")
            for _ in range(rng.randint(1, 3)):
                how = rng.random()
                if how < 0.5:
                    self.several([self.link(self.words(rng.randint(1, 9))) for _ in range(rng.randint(1, 8))])
                elif how < 0.8:
                    self.add(f"<p>{self.said(kind)}</p>")
                else:
                    self.add(f"<div>{self.link(self.words(rng.randint(2, 8)))}<p>{self.sentence(rng.randint(4, 20))}</p></div>")
        elif kind in ("notice", "ad"):
            for _ in range(rng.choice((1, 1, 1, 2))):
                text = self.said(kind) if self.chance(0.7) else " ".join(self.sentence(rng.randint(3, 12)) for _ in range(rng.randint(1, 3)))
                tag = rng.choice(("p", "div", "span", "", "", "strong"))
                self.add(f"<{tag}>{text}</{tag}>" if tag else text)
            if self.chance(0.4):
                self.add(rng.choice((self.link(self.said(kind)), f"<button>{self.said(kind)}</button>", f"<div>{self.link(self.said(kind))}</div>")))
        elif kind == "form":
            own = "form" if "<form" not in begin and self.chance(0.7) else ""
            self.add("<form>" if own else "")
            for _ in range(rng.randint(0 if own else 1, 4)):
                self.add(rng.choice((
                    f"<p><label>{self.said(kind)}</label><input></p>", f"<label>{self.said(kind)} <input type=text></label><br>", f"<div>{self.said(kind)}<textarea>{self.words(2)}</textarea></div>",
                    "<select>" + "".join(f"<option>{self.words(rng.randint(1, 2))}" for _ in range(rng.randint(1, 4))) + "</select>", f"<p>{self.said(kind)}</p>", f"<fieldset><legend>{self.said(kind)}</legend><input></fieldset>",
                )))
            self.add(f"<button>{self.said(kind)}</button>" if self.chance(0.7) else "<input type=submit>", "</form>" if own else "")
        else:
            self.comments()
        self.add(end)

    def comments(self) -> None:
        rng = self.rng
        if self.family == "bare" or self.chance(0.7):
            self.add(f"<h{(k := rng.randint(2, 4))}>{self.said('comments')}</h{k}>")
        how = rng.choice(("div", "div", "ol", "article", "dl", "p", "tr"))
        self.add({"ol": "<ol>", "dl": "<dl>", "tr": "<table>"}.get(how, ""))
        for _ in range(rng.randint(1, 7)):
            who = rng.choice((f"<b>{self.words(rng.randint(1, 2))}</b> {self.said('comments')}", f"<span>{self.words(1)}</span>", f"{self.words(1)}, {rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 25)}:", *([""] if self.family != "bare" else [])))
            text = " ".join(self.sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 4)))
            reply = self.link(self.said("comments")) if self.chance(0.3) else ""
            one = "".join(f"<p>{x}</p>" for x in (who, text, reply) if x) if how != "p" else f"{who} {text} {reply}"
            own = self.names("comments").replace("comments", "comment") if self.chance(0.4) else ""
            self.add({"ol": f"<li{own}>{one}{self.end('li')}", "dl": f"<dt>{who}<dd>{text}", "tr": f"<tr><td>{who}</td><td>{text}</td></tr>", "article": f"<article{own}>{one}</article>", "p": f"<p>{one}</p>"}.get(how, f"<div{own}>{one}</div>"))
        self.add({"ol": "</ol>", "dl": "</dl>", "tr": "</table>"}.get(how, ""))

    def article(self, title: str) -> None:
        rng, m = self.rng, MARK
        begin, end = self.wrap("main")
        self.add(begin)
        if self.chance(0.85):
            self.add(f"<h{(k := rng.choice((1, 1, 1, 2)))}>{m}{title}</h{k}>")
        if self.chance(0.2):
            self.add(f"<p><b>{m}{title}" + rng.choice(("</b></p>", "<br>", "</b><br>")))
        plain = self.chance(0.3)
        body = rng.choice(("p", "p", "p", "p", "div", "div", "br", "span") if self.family != "semantic" else ("p",) * 7 + ("div",))
        same = m + self.prose() if self.chance(0.1) else ""  # a text that the article says over and over
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 14, 25, 50))):
            kind = body if plain else rng.choice((body,) * 7 + ("head", "list", "quote", "bold", "pre", "table", "short", "figure", "dl", "noscript"))
            text = same if same and self.chance(0.7) else m + self.prose()
            if kind == "p":
                self.add(f"<p>{text}{self.end('p')}")
            elif kind == "div":
                self.add(f"<div>{text}</div>")
            elif kind == "span":
                self.add(f"<div><span>{text}</span></div>")
            elif kind == "br":
                self.add(f"{text}<br><br>")
            elif kind == "short":
                self.add(f"<p>{m}{self.sentence(1)}</p>")
            elif kind == "bold":
                self.add(f"<p><b>{text}" + rng.choice(("</b></p>", "</b><br>", "<br>")))
            elif kind == "head":
                self.add(f"<h{(k := rng.randint(2, 5))}>{m}{self.words(rng.randint(1, 7))}</h{k}>")
            elif kind == "list":
                own = rng.choice(("ul", "ol"))
                self.add(f"<{own}>", *(f"<li>{m}{self.words(rng.randint(1, 14))}{self.end('li')}" for _ in range(rng.randint(1, 6))), f"</{own}>")
            elif kind == "dl":
                self.add("<dl>", *(f"<dt>{m}{self.words(2)}<dd>{m}{self.sentence(rng.randint(2, 12))}" for _ in range(rng.randint(1, 3))), "</dl>")
            elif kind == "table":
                self.add("<table>", *("<tr>" + "".join(f"<td>{m}{self.words(rng.randint(1, 3))}{self.end('td')}" for _ in range(rng.randint(1, 4))) + self.end("tr") for _ in range(rng.randint(1, 3))), "</table>")
            elif kind == "figure":
                self.add(f"<figure><img src=x><figcaption>{m}{self.sentence(rng.randint(2, 12))}</figcaption></figure>")
            elif kind == "quote":
                self.add(f"<blockquote><p>{text}</p></blockquote>")
            elif kind == "pre":
                self.add(f"<div><pre>{text}</pre></div>" if self.chance(0.5) else f"<pre>{text}</pre>")
            elif kind == "noscript":
                self.add(f"<noscript><p>{text}</p></noscript>")
            if self.chance(0.06) and self.family != "table":
                self.part(rng.choice(("ad", "ad", "form", "aside", "notice")))
        if self.chance(0.2) and self.family not in ("table", "bare"):
            self.part(rng.choice(("comments", "form", "aside", "ad")))
        self.add(end)

    def made(self) -> str:
        rng = self.rng
        title = self.words(rng.randint(2, 9)) if self.chance(0.5) else self.sentence(rng.randint(1, 30))
        self.add("<!DOCTYPE html><html><head>", f"<title>{title if self.chance(0.7) else self.words(rng.randint(2, 9))}</title>")
        if self.chance(0.6):
            self.add(f"<style>.{self.words(1, False)} > b {{ color: red }}</style>")
        if self.chance(0.6):
            self.add(f'<script>if (1 < 2) {{ write("<i>{self.words(3, False)}</i>") }}</script>')
        self.add("</head><body>")
        before = [k for k, p in (("notice", 0.3), ("header", 0.45), ("nav", 0.75), ("form", 0.2), ("ad", 0.4), ("notice", 0.15), ("aside", 0.2)) if self.chance(p)]
        after = [k for k, p in (("comments", 0.4), ("ad", 0.25), ("aside", 0.4), ("form", 0.2), ("footer", 0.8), ("notice", 0.2)) if self.chance(p)]
        if self.chance(0.3):
            rng.shuffle(before)
        rows: Callable[[str], str] = lambda x: x if self.family == "table" else ""
        outer = rng.randint(0, 3) if self.family not in ("bare", "table") else 0
        self.add(*(f'<div class="{self.idle()}">' if self.chance(0.5) else "<div>" for _ in range(outer)), rows("<table>"))
        for kind in before:
            self.add(rows("<tr>"))
            self.part(kind)
            self.add(rows(rng.choice(("</tr>", "</tr>", ""))))
        self.add(rows("<tr>"))
        beside = self.family == "table" and self.chance(0.5)
        if beside:
            self.part(rng.choice(("nav", "aside")))
        self.article(title)
        if self.family == "table" and self.chance(0.3):
            self.part(rng.choice(("aside", "ad")))
        self.add(rows("</tr>"))
        for kind in after:
            self.add(rows("<tr>"))
            self.part(kind)
            self.add(rows("</tr>"))
        self.add(rows("</table>"), "</div>" * outer, rng.choice(("</body></html>", "</body></html>", "")))
        return "".join(self.html)


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def made_page(rng: random.Random, family: str) -> str:
    return Page(rng, family).made()
