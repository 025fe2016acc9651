"""The small labelled table of the block classifier.

Pages are put together from layouts; in a layout ``{k:5}`` stands for five
words of main text and ``{d:5}`` for five words of other matter.  The words
begin with that letter, so each block carries its own label.
"""

from __future__ import annotations

import random
import re

# Page layouts.  A body is written as a list of pieces.
MENU = '<nav><ul><li><a href="/1">{d:1}</a></li><li><a href="/2">{d:2}</a></li><li><a href="/3">{d:1}</a></li></ul></nav>'
MENU_DIVS = '<div><a href="/1">{d:1}</a> <a href="/2">{d:2}</a> <a href="/3">{d:1}</a></div>'
TABLE_MENU = '<table><tr><td><a href="/1">{d:1}</a></td><td><a href="/2">{d:2}</a></td></tr></table>'
AD = '<div class="ad">{d:9}.</div>'
LONG_AD = '<div class="advert"><p>{d:40}.</p></div>'
SIDEBAR = '<aside><h3>{d:2}</h3><p>{d:25}.</p><ul><li><a href="/4">{d:4}</a></li></ul></aside>'
SIDEBAR_DIV = '<div class="sidebar"><h3>{d:2}</h3><p>{d:30}.</p></div>'
NOTICE = '<div class="cookie-notice"><p>{d:18}.</p><button>{d:1}</button></div>'
FORM = '<form action="/s"><label>{d:2}</label><input type="text"><p>{d:8}.</p><button>{d:1}</button></form>'
COMMENTS = '<section id="comments"><h3>{d:1}</h3><div class="comment"><p>{d:22}.</p></div><p>{d:35}.</p></section>'
FOOTER = "<footer><p>&copy; {d:6}.</p></footer>"
FOOTER_DIV = '<div>&copy; {d:3} <a href="/5">{d:2}</a> <a href="/6">{d:2}</a></div>'
HEADER = '<header><h1>{d:3}</h1><p>{d:6}</p></header>'
BARE = "<div>{d:9}.</div><p>{d:28}.</p>"
BARE_SHORT = "<div>{d:2}</div><p>{d:5}.</p>"
LINE = "<div>{d:3}</div>"
STAMP = "<div>{d:4} {d:1}</div>"
RELATED = '<ul><li><a href="/7">{d:6}</a></li><li><a href="/8">{d:7}</a></li><li><a href="/9">{d:5}</a></li></ul>'
TEXT = ("<h1>{k:6}</h1><p>{k:30}.</p><p>{k:1}.</p><h2>{k:3}</h2><p>{k:80}.</p><p>{k:4}, <a href='/10'>{k:2}</a> {k:12}.</p>"
        "<ul><li>{k:7}</li><li>{k:2}</li></ul><blockquote>{k:15}.</blockquote><p>{k:3}</p><p>{k:45}.</p>")
SHORT = "<h1>{k:4}</h1><p>{k:2}.</p><p>{k:6}.</p>"
LONG = "<h1>{k:9}</h1>" + "<p>{k:60}.</p>" * 4 + "<p>{k:1}.</p><p>{k:110}.</p>"
TABLE = "<h1>{k:4}</h1><p>{k:30}.</p><table><tr><td>{k:2}</td><td>{k:3}</td></tr></table><pre>{k:12}</pre>"
PLAIN = "<p>{k:40}.</p><p>{k:25}.</p><p>{k:55}.</p><p>{k:33}.</p>"

WHOLE = [f"<article>{t}</article>" for t in (TEXT, SHORT, LONG, TABLE)] + [f"<main>{t}</main>" for t in (TEXT, SHORT)] \
    + [f'<div class="{c}">{t}</div>' for c, t in (("post-content", TEXT), ("entry", LONG), ("story", SHORT))]
BEFORE = [MENU + AD, HEADER + MENU, MENU + NOTICE, MENU_DIVS + LONG_AD, HEADER + FORM + AD, TABLE_MENU, ""]
AFTER = [FOOTER, SIDEBAR + FOOTER, COMMENTS + FOOTER, SIDEBAR_DIV + FORM + FOOTER, RELATED + FOOTER_DIV,
         COMMENTS + NOTICE + FOOTER_DIV, ""]
# pages without an article element or telling names: short lines by link lists are other matter
OPEN_BEFORE = [MENU_DIVS + LINE, LINE + TABLE_MENU, LINE + MENU_DIVS + STAMP, MENU + STAMP]
OPEN_AFTER = [LINE + RELATED, STAMP + FOOTER_DIV, RELATED + LINE + FOOTER_DIV, LINE + MENU_DIVS]
# Neutral and misleading names: blocks of one kind, told apart by their words and their neighbours alone.
NEUTRAL = ['<div class="c1 w2">{}</div>', "<div>{}</div>", '<section class="layout has-sidebar">{}</section>',
           '<div class="page tag-menu category-legal">{}</div>', '<div class="site no-header" data-id="sidebar" title="hidden ads">{}</div>']
SHORT_LINES = ["<div>{k:3}</div>", "<p>{k:2}</p>", "<ul><li>{k:4}</li><li>{k:3}</li></ul>", '<p><a href="/11">{k:5}</a></p>', "<div>{k:1}.</div>"]
LINKED_LINES = ['<div>{d:3}</div><div><a href="/12">{d:4}</a></div>', '<p>{d:2}</p><p><a href="/13">{d:5}</a> <a href="/14">{d:3}</a></p>',
                '<ul><li>{d:4}</li><li><a href="/15">{d:3}</a></li><li>{d:3}</li><li><a href="/16">{d:4}</a></li></ul>',
                '<p><a href="/17">{d:5}</a></p><p><a href="/18">{d:4}</a></p><p><a href="/19">{d:6}</a></p>']
INSIDE = [AD, COMMENTS, SIDEBAR, NOTICE, FORM, MENU, RELATED]


def _fill(layout: str, rng: random.Random) -> str:
    def words(m):
        n = int(m[2])
        n = max(1, n if n < 3 else round(n * rng.uniform(0.6, 1.6)))
        return " ".join(m[1] + "".join(rng.choice("aeimnorst") for _ in range(rng.randint(1, 8))) for _ in range(n))
    return re.sub(r"\{([kd]):(\d+)\}", words, layout)


def labelled_pages(seed: int = 11) -> list[str]:
    """About 430 pages: every article form with several surroundings, with
    other matter inside the article, pages without article elements, and pages
    whose names say nothing or mislead."""
    rng = random.Random(seed)
    pages = []
    for i, body in enumerate(WHOLE):
        for j in range(len(BEFORE)):
            pages.append(BEFORE[j] + body + AFTER[(i + j) % len(AFTER)])
        for extra in INSIDE:
            cut = body.index("</p>") + 4
            pages.append(MENU + body[:cut] + extra + body[cut:] + FOOTER)
    for body in WHOLE:
        for extra in (BARE, BARE_SHORT, LINE, STAMP):
            pages.append(MENU + extra + body + FOOTER)
            pages.append(HEADER + body + extra + FOOTER)
    for before in OPEN_BEFORE:
        for after in OPEN_AFTER:
            for text in (PLAIN, "<h1>{k:5}</h1>" + PLAIN, PLAIN + "<p>{k:2}.</p><p>{k:20}.</p>"):
                pages.append(before + f"<div>{text}</div>" + after)
    for before in BEFORE:
        for after in AFTER[:6:2]:
            pages.append(before + f"<div>{PLAIN}</div>" + after)
    for i, wrap in enumerate(NEUTRAL):
        for j, short in enumerate(SHORT_LINES):
            text = "<p>{k:35}.</p>" + short + "<p>{k:50}.</p>" + SHORT_LINES[(i + j) % 5] + "<p>{k:28}.</p>"
            for links in LINKED_LINES:
                before = wrap.format(MENU_DIVS + links) if (i + j) % 2 else links
                pages.append(before + wrap.format(text) + wrap.format(links + RELATED))
    for body in (f"<article>{TEXT}</article>", f"<main>{PLAIN}</main>"):
        for j, short in enumerate(SHORT_LINES):
            cut = body.index("</p>") + 4
            for extra in (RELATED, LINKED_LINES[3]):
                pages.append(MENU + body[:cut] + short + body[cut:].replace("</p>", "</p>" + extra, 2) + FOOTER)
    for body in (f"<article>{PLAIN}</article>", f'<article class="post">{LONG}</article>', f"<main>{TEXT}</main>", f"<div>{PLAIN}</div>"):
        for line in ('<p><a href="/20">{k:5}</a></p>', '<p><a href="/21">{k:9}</a></p>', '<div><a href="/22">{k:4}</a></div>'):
            ends = [m.end() for m in re.finditer("</p>", body)]
            pages += [MENU + body[:cut] + line + body[cut:] + FOOTER for cut in ends[:-1]]
    return [f"<html><head><title>d</title></head><body>{_fill(p, rng)}</body></html>" for p in pages]
