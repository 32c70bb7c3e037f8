"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of text pieces and tags. Tags score below zero. A word's score
is its log-odds of being content, by a logistic model of what it stands in (elements,
the words of their classes, ids and roles, links, lists of links), cut to -1 and 1. The model's weights and the tags' costs are learned on labelled pages.
One scan over the scores finds the contiguous region with the largest sum; the
text pieces of the region that score above zero are the result: character
references decoded, white space of a block made one space, blocks joined by line
breaks in the order of the page. Inside the main element a run of words that are
no content costs half a word, so a long advert doesn't cut an article in two.

Only what a browser doesn't show is left out without a score: scripts, styles,
comments, hidden elements and the like.

Defined results: a null or empty html, or one without content, gives the empty
text; cut-off pages and unclosed tags are read to their end; a comment, script or
style that never ends reaches to the end; a null url stays null; repeated rows are
read one by one; pages are read whole at any length; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_strings, slices

RESULT = "page_id bigint, url string, text string"
#: Elements that a browser doesn't show as text.
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas audio video select textarea button datalist".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that are often left open; they don't hold others back.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option b i em strong span a u small font h1 h2 h3 h4 h5 h6 br hr img input meta link wbr area base col embed source track param".split())
VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
#: Elements whose names say something of their content.
TELLING = frozenset("nav footer aside form menu dialog header article main".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[a-z]+")
_HIDES = re.compile(r"\sstyle\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none)|\saria-hidden\s*=\s*[\"']?true", re.I)
_HIDDEN_WORD, _QUOTED = re.compile(r"\shidden(?=[\s>=/])", re.I), re.compile(r"\"[^\"]*\"|'[^']*'")


def _hides(tag: str) -> bool:
    """Whether a tag hides its element: by an attribute of its own, not by words in the values of others."""
    return bool("=" in tag and _HIDES.search(tag)) or "hidden" in tag.lower() and bool(_HIDDEN_WORD.search(_QUOTED.sub('""', tag)))


@functools.lru_cache(20_000)
def _features(name: str, tag: str, in_main: bool) -> tuple[str, ...]:
    """What an element says of the words in it: its name, and the words of its class, id and role."""
    found = [name] if name in TELLING else []
    if "=" in tag:
        heading = "heading " if re.fullmatch("h[1-6]", name) else ""
        for kind, value in _MARKS.findall(tag):
            parts = _PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
            found += [f"{heading}{kind.lower()} {x}" for x in dict.fromkeys(parts)]
    return tuple("in " + x for x in found) if in_main else tuple(found)


def tokens(page: str) -> Iterator[tuple[str, tuple[str, ...], bool, str]]:
    """(kind, features, whether in a main element, text); kind is text, or for tags block or tag."""
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # open elements: name, features of all so far, whether hidden
    hidden, main, link, item = 0, 0, 0, 0
    n_main = sum(1 for _ in re.finditer(r"<(?:article|main)\b", page, re.I))
    has_main = n_main > 0
    for m in _TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            if not hidden:
                own = [x for x, on in (("outside", has_main and not main), ("link", link), ("item link", link and item), ("copyright", "©" in token or "&copy" in token)) if on]
                yield "text", (*(stack[-1][1] if stack else ()), *(["in " + x for x in own] if main else own)), main > 0, token
            continue
        named = _NAME.match(token)
        if m[1] or not named:  # scripts and the like as a whole, comments, declarations
            continue
        name, closing = named[1].lower(), token[1] == "/"
        if closing:
            if name == "a":
                link = 0
            elif name == "li":
                item = 0
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if at >= 0:
                for was, _, flag in stack[at:]:
                    hidden -= flag
                    main -= was in MAIN
                del stack[at:]
        elif name not in VOID and not token.endswith("/>"):
            flag = name in HIDDEN or _hides(token)
            if name == "a":
                link = 1
            elif name == "li":
                item = 1
            only = n_main == 1 and name in MAIN  # what the one main element is called doesn't make it another part of the page
            own = _features(name, token if "=" in token and not only else "", main > 0)
            if flag or own or name not in LOOSE:
                stack.append((name, (*(stack[-1][1] if stack else ()), *own), flag))
                hidden += flag
                main += name in MAIN
        yield ("block" if name in BLOCK else "tag"), ("in " + name if main else name,), main > 0, ""


#: Labelled pages: what stands between {{ and }} is content.
LABELLED = (
    '<html><head><title>T</title></head><body><header><a href="/">Home</a></header><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav><article>{{<h1>A storm over the bay</h1><p>The wind rose at dawn and the boats stayed in the harbour all day long.</p><p>By night it was <b>calm</b> again, as <a href="/c">the pilots</a> had said it would be.</p>}}</article><footer>Copyright</footer></body></html>',
    '<body><div class="cookie-notice">We use cookies on this site</div><div id="menu"><a href="/1">One</a> <a href="/2">Two</a></div><div class="post">{{<h2>On baking bread</h2><p>Flour, water and salt are all it takes, and time above all.</p><ul><li>Mix the dough in the evening</li><li>Bake it in the morning</li></ul>}}</div><div class="sidebar"><h3>More</h3><p>Ten recipes for soup</p></div><div class="comments"><p>Great, thank you so much!</p></div></body>',
    '<body><ul><li><a href="/x">Start</a></li><li><a href="/y">Archive</a></li></ul><main>{{<h1>Minutes of the meeting</h1><p>The board met on Monday with nine members present and two excused.</p><blockquote>We shall build the bridge, said the chair.</blockquote>}}</main><form><label>Your mail</label><input></form><footer><p>All rights reserved by the town</p></footer></body>',
    '<body><ul><li><a href="/x">Start page</a></li><li><a href="/y">All articles</a></li><li><a href="/z">About us</a></li></ul><div>{{<h1>A walk in the hills</h1><p>The path climbs through old woods to a chapel.</p>}}</div><div class="footer">Imprint</div></body>',
    '<body><div class="ad">Buy now and save</div><article>{{<p>Short text.</p>}}<section class="comments"><p>First comment here</p><p>Second comment there</p></section></article></body>',
)


#: Labelled main elements with marked parts.
MARKED = (
    '<article>{{<div class="entry-header"><h1>A storm over the bay</h1></div><h2 id="related-work">Work that came before</h2><p>Text</p><section id="discussion"><h2 class="section-header">Discussion</h2><p>The results agree with what the pilots saw.</p></section>}}<div class="share">Share this</div><div class="related"><p>More stories</p></div></article>',
    '<main>{{<header class="post-header"><h1>Bread</h1></header><h2 id="how-to-search">How to search for flour</h2><p>Ask the miller.</p><h3 id="side-effects">Effects on the side</h3><section id="notices"><p>The mill gives notice of its sales in spring.</p></section>}}<div class="ad">Buy now</div><div id="comments" class="comments"><p>Great, thank you so much!</p></div><div id="respond">Leave a reply</div><div id="sidebar"><p>Ten recipes</p></div><h3 class="related-title">You may also like</h3></main>',
    '<main>{{<h1>Minutes</h1><section id="social-history"><p>The village had two schools.</p></section>}}<div role="complementary">Elsewhere</div><div role="navigation">Next page</div><div id="newsletter">Our letter by mail</div><div id="related">Other minutes</div><div id="share">Share</div><div id="ad">Save now</div><div id="disqus">Talk to us</div></main>',
)

#: Words of classes, ids and roles of menus, adverts and the like; labelled pages are built with each of them. Fixed values.
SIDE_MARKS = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond reactions "
    "widget search pagination pager copyright complementary contentinfo dialog"
).split()
#: Classes of the article itself and of its parts, some of them with words of the list above. Fixed values.
CONTENT_MARKS = ("post", "entry", "content", "story", "text", "post-body", "entry-content", "article-body", "main-content", "related-work", "post-header", "entry-header", "article-header", "section-header", "lead", "quote", "note", "caption")


def built_pages() -> Iterator[str]:
    """Labelled pages in which every mark stands outside and inside the main element, and around unmarked layouts."""
    story = "<h1>A storm over the bay</h1><p>The wind rose at dawn and the boats stayed in the harbour all day long.</p><p>By night it was calm.</p>"
    for w in SIDE_MARKS:
        other = f'<div class="{w}"><p>Words of another kind that stand here for some reason</p></div><div id="{w}">Few words</div><div role="{w}">More</div><div class="{w}-box">Words</div>'
        yield f"<body>{other}<article>{{{{{story}}}}}{other}{{{{<p>Then the pilots came back.</p>}}}}</article>{other}</body>"
        yield f"<body>{other}<div>{{{{{story}}}}}</div>{other}</body>"
    for w in CONTENT_MARKS:
        yield f'<body><nav>Home</nav><main>{{{{<div class="{w}">{story}</div><section id="{w}"><p>Then the pilots came back.</p></section><h2 id="{w}">On</h2>}}}}<aside>See also</aside></main><footer>End</footer></body>'
        yield f'<body><div class="menu">Home</div><div class="{w}">{{{{{story}}}}}</div><div class="footer">End</div></body>'
    for w in ("site-header", "page-header", "header"):
        yield f'<body><div class="{w}">The paper of the bay <p>since 1890</p></div><div id="{w}">Old</div><div>{{{{{story}}}}}</div></body>'
    for w in ("comment", "comments", "reply"):
        yield f'<body><article class="post">{{{{{story}}}}}</article><article class="{w}"><p>Great, thank you so much for this, I had not known any of it!</p></article><main><article class="{w}">Nice</article></main></body>'
        yield f'<body><main>{{{{{story}}}}}<section><article class="{w}"><p>Great, thank you so much for this, I had not known any of it!</p></article></section></main></body>'
    for w in ("posts", "articles", "stories", "links", "news"):
        yield f'<body><article>{{{{{story}}}}}<div class="related-{w}"><p>Other things to read on this site today</p></div></article><div class="recommended-{w}">More</div></body>'
    for x in ("nav", "footer", "aside", "form", "menu", "dialog"):
        other = f"<{x}><p>Words of another kind that stand here for some reason</p>Few words</{x}>"
        yield f"<body>{other}<article>{{{{<header>{story}</header>}}}}{other}{{{{{story}}}}}</article>{other}<header>The paper of the bay</header><p>Not of the article, yet a long line of words without any mark</p></body>"
        yield f"<body>{other}<header>The paper of the bay</header><div>{{{{{story}}}}}</div>{other}<p>&copy; 2024 by us</p></body>"


@functools.lru_cache(4)
def learn(pages: tuple[str, ...] | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words' features (with "" for all words) and costs of tags, from pages where {{ and }} enclose the content."""
    rows, label, mass = [], [], []
    tags = {True: Counter(), False: Counter()}
    for page in pages or (*LABELLED, *MARKED, *built_pages()):
        now = False
        for kind, features, _, text in tokens(page.replace("{{", "\x01").replace("}}", "\x02")):
            if kind != "text":
                tags[now][features[0]] += 1
                continue
            for part in re.split("([\x01\x02])", text):
                now = part == "\x01" if part in ("\x01", "\x02") and part else now
                if part.strip("\x01\x02 \n"):
                    rows.append(features)
                    label.append(now)
                    mass.append(len(part.split()))
    names = sorted({f for r in rows for f in r})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r]] = 1
    y, w = np.array(label, float), np.sqrt(np.array(mass, float))  # a long piece says more than a short one, but not by its length
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta)), x.T @ (w * (y - p)) - 0.05 * beta)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    weights = {f: float(b) for f, b in zip([*names, ""], beta)}
    total = {k: sum(c.values()) + 1 for k, c in tags.items()}
    odds = lambda t: math.log((tags[True][t] + 0.5) / total[True]) - math.log((tags[False][t] + 0.5) / total[False])
    # a tag within the main element costs a hundredth, as no menu stands between the parts of an article there
    return weights, {t: min(-0.001, odds(t) / 10) / (100 if t.startswith("in ") else 1) for t in {*tags[True], *tags[False]}}


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum above zero, as a half-open range; the first and longest of equal ones."""
    best, at, start, run = 0.0, (0, 0), 0, 0.0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best or run == best and best > 0 and start == at[0]:
            best, at = run, (start, i + 1)
    return at


def extract(page: str, model: tuple[dict[str, float], dict[str, float]], scan: bool = True) -> str:
    """The main text of a page; without ``scan`` all text that scores above zero."""
    weights, costs = model
    base, known = weights.get("", 0.0), {}
    sequence, scores, side = [], [], False
    for kind, features, in_main, text in tokens(page):
        if kind != "text":
            value = 0.0 if side else costs.get(features[0], -1e-5 if in_main else -0.01)
        else:
            if features not in known:
                known[features] = max(-1.0, min(1.0, base + sum(weights.get(f, 0.0) for f in features)))
            value, n = known[features], len(text.split())
            if value <= 0 and in_main:  # however long, a run that is no content costs half a word there
                value, side = 0.0 if side or not n else -0.5, True
                text = None
            elif value <= 0:
                value, text, side = value * n, None, False
            elif n:
                value, side = value * n, False
        sequence.append((kind, text))
        scores.append(value)
    start, end = region(scores) if scan else (0, len(scores))
    blocks, block = [], []
    for kind, text in sequence[start:end]:
        if kind == "block":
            blocks.append("".join(block))
            block = []
        elif kind == "text" and text is not None:
            block.append(text)
    blocks.append("".join(block))
    clean = (" ".join(html.unescape(b).split()) for b in blocks if b)
    return "\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame, labelled: tuple[str, ...] | None = None) -> DataFrame:
    """RESULT for each row of (page_id, url, html); ``labelled`` are pages of your own to learn from."""
    model = learn(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([extract(x, model) for x in arrow_strings(batch["html"])], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, RESULT)
