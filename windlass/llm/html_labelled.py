"""Labelled pages to train on: built from a seed, with the parts that real pages mix, and each block's label known."""

from __future__ import annotations

import html
import random

# Usual element and class names of page parts.
MENU = ["nav", "div.menu", "div.navbar", "ul.nav", "div.breadcrumb", "div#navigation", "div.topnav", "div.toc"]
HEAD = ["header", "div#header", "div.masthead", "div.site-header", "div.topbar", "div.branding"]
FOOT = ["footer", "div#footer", "div.site-footer", "div.copyright", "div.legal", "div.colophon"]
SIDE = ["aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "section.recommended", "div.trending", "div.tags", "div.share", "div.social", "div.author-box"]
NOTE = ["div.cookie-banner", "div.notice", "div.alert", "div.consent", "div.popup", "div.newsletter", "div.banner", "div.modal", "div.disclaimer", "div.gdpr", "div.paywall", "section.notification"]
ADS = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div#ad-slot", "section.promoted"]
TALK = ["section.comments", "div#comments", "ol.commentlist", "div.comment", "div.replies", "div#respond", "ul.comment-list", "div.discussion", "section.responses", "div.disqus"]
MAIN = ["article", "article.post", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#content", "div.text", "article.entry", "div#main-content", "div"]
PHRASES = ["Copyright 2020. All rights reserved.", "We use cookies to improve this site.", "Subscribe to our newsletter", "Log in to reply", "Share this", "Privacy policy", "Advertisement", "Sponsored", "Terms of use", "12 comments", "Posted by", "Read more"]


def _words(rng: random.Random, least: int, most: int, stock: list[str]) -> str:
    n = rng.randint(least, most)
    out = [rng.choice(stock) + ("," if rng.random() < 0.08 else ". " if rng.random() < 0.06 else "") for _ in range(n)]
    text = " ".join(" ".join(out).split())
    return text[:1].upper() + text[1:] + ("." if n > 5 and rng.random() < 0.9 else "")


def _open(kind: str) -> tuple[str, str]:
    tag = kind.replace("#", ".").split(".")[0]
    name = kind[len(tag) + 1 :]
    return (f'<{tag} {"id" if "#" in kind else "class"}="{name}">' if name else f"<{tag}>"), f"</{tag}>"


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page and, for each of its blocks in page order, 1 for main text and 0 for all else."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice("bcdfghklmnprstvwzßñç") + rng.choice("aeiouéäö")) + rng.choice(["", "n", "s", "r", "l"]) for _ in range(40)]
    stock = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    labels: list[int] = []
    esc = lambda s: html.escape(s, quote=rng.random() < 0.5)

    def line(label: int, least: int, most: int, tag: str = "p") -> str:
        labels.append(label)
        text = esc(_words(rng, least, most, stock))
        if label and rng.random() < 0.15:
            text = f"<b>{text}" if rng.random() < 0.5 else f"<em>{text}</em>"
        if rng.random() < 0.1:
            text += f' <a href="/x">{esc(rng.choice(stock))}</a>'
        if label and rng.random() < 0.08:  # the same phrases inside a story are part of it
            text = esc(rng.choice(PHRASES))
        if not label and rng.random() < 0.25:
            text = esc(rng.choice(PHRASES)) + (" " + text if rng.random() < 0.5 else "")
        return f"<{tag}>{text}" + ("<br>" if tag == "p" and rng.random() < 0.1 else f"</{tag}>")

    def links(n: int) -> str:
        labels.extend([0] * n)
        items = "".join(f'<li><a href="/{i}">{esc(_words(rng, 1, 3, stock))}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>"

    def part(kinds: list[str], body) -> str:
        begin, end = _open(rng.choice(kinds))
        return begin + body() + end

    def bare(least: int, most: int) -> str:
        labels.append(0)
        text = _words(rng, least, most, stock)
        return esc(rng.choice(PHRASES) + " " + text if rng.random() < 0.3 else text)

    def side() -> str:
        head = line(0, 1, 4, rng.choice(["h2", "h3", "h4"])) if rng.random() < 0.6 else ""
        return head + (links(rng.randint(2, 6)) if rng.random() < 0.6 else line(0, 5, 30))

    def talk() -> str:
        out = line(0, 1, 4, "h3") if rng.random() < 0.6 else ""
        for _ in range(rng.randint(1, 4)):
            name = rng.choice(["", ' class="comment"', ' class="reply"', ""])
            out += f"<div{name}>" + (line(0, 1, 3, "h4") if rng.random() < 0.4 else "") + line(0, 4, 60) + "</div>"
        return out

    def form() -> str:
        labels.extend([0, 0, 0])
        return f'<form action="/s"><label>{esc(rng.choice(stock))}</label><input name="q"><p>{esc(_words(rng, 1, 8, stock))}</p><button>{esc(rng.choice(stock))}</button></form>'

    def extra() -> str:
        return rng.choice([lambda: part(ADS, lambda: bare(3, 30)), lambda: part(SIDE, side), lambda: part(NOTE, lambda: line(0, 4, 30)), form])()

    def story() -> str:
        out = line(1, 3, 14, rng.choice(["h1", "h1", "h2"]))
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.72:
                out += line(1, 3, 90)
            elif r < 0.80:
                out += line(1, 1, 8, rng.choice(["h2", "h3"]))
            elif r < 0.86:
                out += "<ul>" + "".join(line(1, 2, 15, "li") for _ in range(rng.randint(2, 4))) + "</ul>"
            elif r < 0.90:
                out += "<blockquote>" + line(1, 5, 40) + "</blockquote>"
            else:
                out += extra()
        return out + (part(TALK, talk) if rng.random() < 0.15 else "")

    title = esc(_words(rng, 3, 9, stock))
    out = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var a="<p>no</p>";</script></head><body>'
    if rng.random() < 0.3:
        out += part(NOTE, lambda: line(0, 4, 40))
    if rng.random() < 0.5:
        out += part(HEAD, lambda: line(0, 1, 5, rng.choice(["h1", "p", "div"])) + (links(3) if rng.random() < 0.5 else ""))
    if rng.random() < 0.9:
        out += part(MENU, lambda: links(rng.randint(3, 8)))
    for _ in range(rng.randint(0, 2)):
        out += "<!-- part -->" + extra()
    out += part(MAIN, story)
    for _ in range(rng.randint(0, 2)):
        out += extra()
    if rng.random() < 0.4:
        out += part(TALK, talk)
    if rng.random() < 0.85:
        out += part(FOOT, (lambda: bare(3, 30)) if rng.random() < 0.5 else lambda: line(0, 3, 25))
    return out + "</body></html>", labels
