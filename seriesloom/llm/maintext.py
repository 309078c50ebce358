"""Main text of web pages: flat text blocks classified by a decision tree.

Blocks in elements that hold no main text (navigation, footers, sidebars, forms, and those
whose role, class or id says so) are no candidates, but count as neighbours. A candidate's
features are its words and link density, those of the blocks before and after it, what kind
of element it is, and whether the page's article holds it. The tree is trained on the
labelled pages below, of layouts with and without sectioning elements.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_RAW = re.compile(r"</(script|style|noscript|template|textarea|svg|iframe|select|button|title)", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.I)
_HREF = re.compile(r"\bhref\b", re.I)
# landmark roles and the elements they stand for
ROLES = {"banner": "header", "complementary": "aside", "contentinfo": "footer", "dialog": "dialog", "form": "form", "main": "main", "menu": "menu", "navigation": "nav", "search": "form", "article": "article"}
SKIPPED = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "button", "title"}
UNWANTED = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
WANTED = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | UNWANTED | WANTED | set("html body header p div section ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address fieldset legend details summary center".split())
# parts of names of classes and ids that tell what is no main text
NAMED = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments disqus reply replies respond nav navbar navigation menu breadcrumb breadcrumbs sidebar footer"
    " related recommended share sharing social newsletter subscribe subscription signup cookie cookies consent gdpr notice popup modal pagination pager login".split()
)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# elements that end when their parent does; only what can hold blocks is kept open
HOLDERS = BLOCKS - HEADINGS - {"p", "hr", "pre"}
FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "article", "nested_article", "heading", "paragraph", "list_item"]


def _named(rest: str) -> bool:
    """Whether a tag's class or id says that it holds no main text."""
    return any(part.lower() in NAMED for m in _NAMES.finditer(rest) for part in _PART.findall(m[1] or m[2] or m[3] or ""))


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """The page's candidates (text, features), in order.

    article: 1 in an article or main element, -1 outside of those that the page has.
    """
    out: list[list] = []
    text: list[str] = []
    linked = 0
    in_link = heading = paragraph = item = articles = alone = False
    link_depth = 0
    stack: list[tuple[str, int, int]] = []  # element, whether it is wanted and unwanted
    wanted = unwanted = 0

    def flush() -> None:
        nonlocal text, linked
        words = html.unescape("".join(text)).split()
        if words:
            out.append([" ".join(words), len(words), min(1.0, linked / len(words)), float(wanted > 0), float(wanted > 1), float(unwanted > 0 or alone), float(heading), float(paragraph), float(item)])
        text, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece.split())

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, start)
        if not m:
            if not re.match(r"</?[a-zA-Z]", page[start : start + 3]) and start + 1 < end and page[start + 1 : start + 2] != "/":
                add("<")  # a bare sign
                at = start + 1
                continue
            stop = page.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        at = m.end()
        closing, name, rest = m[1], m[2].lower(), m[3]
        if name in SKIPPED:
            if not closing and not rest.endswith("/"):
                stop = next((k for k in _RAW.finditer(page, at) if k[1].lower() == name), None)
                tail = page.find(">", stop.end()) if stop else -1
                at = tail + 1 if tail >= 0 else end
            continue
        if name == "a":  # a link goes on through the blocks that it holds
            in_link = not closing and bool(_HREF.search(rest))
            link_depth = len(stack)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        heading = name in HEADINGS and not closing
        if not closing and name not in HOLDERS:
            alone = _named(rest)  # a heading or paragraph that names itself
        elif name not in HOLDERS or not closing:
            alone = False
        paragraph = name in ("p", "pre", "blockquote") and not closing
        if name == "li":
            item = not closing
        if name not in HOLDERS:
            continue
        if closing:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                wanted -= sum(s[1] for s in stack[k:])
                unwanted -= sum(s[2] for s in stack[k:])
                del stack[k:]
                in_link = in_link and len(stack) >= link_depth
            continue
        role = _ROLE.search(rest)
        means = ROLES.get(role[1].lower(), name) if role else name
        good = means in WANTED and not (means == "article" and stack and stack[-1][0] == "main")
        bad = means in UNWANTED or (means == "header" and not wanted) or (name not in ("html", "body", "article", "main") and _named(rest))
        if name == "body":
            unwanted -= sum(s[2] for s in stack)
            wanted -= sum(s[1] for s in stack)
            stack.clear()
        stack.append((name, int(good), int(bad)))
        wanted += good
        unwanted += bad
        articles |= good
    flush()
    found = []
    for i, (words, n, density, inside, nested, bad, head, par, li) in enumerate(out):
        before = out[i - 1][1:3] if i else [0, 0.0]
        after = out[i + 1][1:3] if i + 1 < len(out) else [0, 0.0]
        place = inside if inside or not articles else -1.0
        if not bad:
            found.append((words, [float(n), density, *map(float, before), *map(float, after), place, nested, head, par, li]))
    return found


def _text(n: int, main: bool = False) -> str:
    words = ("it tells the reader of the matter and of what came of it in the end " * (n // 15 + 1)).split()
    return " ".join([*(["Main"] if main else []), *words][:n])


def _p(*lengths: int, tag: str = "p") -> str:
    """Paragraphs of the main text."""
    return "".join(f"<{tag}>{_text(n, True)}</{tag}>" for n in lengths)


def _h(n: int = 5, level: int = 1) -> str:
    return f"<h{level}>{_text(n, True)}</h{level}>"


def _a(n: int) -> str:
    return f'<a href="/x">{_text(n)}</a>'


def _links(k: int, n: int) -> str:
    return "<ul>" + f"<li>{_a(n)}</li>" * k + "</ul>"


def _layouts(k: int) -> dict[str, str]:
    """A page of each layout; k varies lengths and counts."""
    few, some, long = 6 + 2 * k, 15 + 3 * k, 45 + 15 * k
    return {
        # with sectioning elements
        "blog": f"<nav>{_links(4, 1)}</nav><div>{_text(8)}</div><article>{_h(4 + k)}{_p(1, long, 2, some, 3, long, k + 1)}</article><footer>{_text(9)}</footer>",
        "news": f"<header>{_a(2)} {_text(20)}</header><main>{_h(9)}{_p(few, some)}<ul><li>{_text(6, True)}</li><li>{_text(3 + k, True)}</li></ul>{_p(long, 2)}{_links(3, 6)}</main><aside>{_text(40)}</aside><p>{_text(7)}</p>",
        "thread": f"<p>{_text(5)}</p><article><header>{_h()}</header>{_p(some, 4, long)}<article><p>{_text(30)}</p><p>{_text(3)}</p></article></article><section><p>{_text(35)}</p><p>{_text(4 + k)}</p></section>",
        "wiki": f"<div>{_text(30)}</div><p>{_text(60)}</p><main>{_h(2)}{_p(long)}{_h(3, 2)}{_p(long, some)}<p>{_text(9 + k, True)} {_a(2)}</p><p>{_a(5)} {_a(5)} {_a(4 + k)}</p></main><div>{_text(45)}</div>",
        "list": f"<article>{_h(6)}<ol>{''.join(f'<li>{_text(2 + (i * k) % 30, True)}</li>' for i in range(6))}</ol>{_p(some)}{_links(4, 9 + k)}</article><div>{_text(12)}</div>",
        "linked": f"<div>{_links(3, 2)}</div><article>{_h(3)}<p>{_text(20, True)} {_a(12 + 2 * k)}</p>{_p(some)}<p>{_text(8, True)} {_a(6 + k)}</p>{_p(long)}<p>{_text(30, True)} {_a(30)}</p></article>",
        # without: lengths and links of a block and of its neighbours have to tell
        "plain": f"{_h()}{_p(*[some] * 8)}",
        "essay": f"{_h(8)}{_p(*[long] * 6)}<p>{_text(4)}</p>",
        "notes": f"<div>{_a(2)} {_a(1)} {_a(2)}</div>{_h(4)}{_p(some, few, some + 9, few, few, some, 12 + k)}<div>{_a(1)} {_a(3)}</div><div>{_text(3 + k)}</div>",
        "mixed": f"<div>{_text(4)}</div>{_links(5, 2)}{_h(3 + k)}{_p(long, few, some)}{_h(3, 2)}{_p(some, long, 9)}{_links(3, 4 + k)}<div>{_text(6)}</div>",
        "cells": f"<table><tr><td>{_a(2)}</td><td>{_a(3)}</td></tr><tr><td>{_text(70 + k, True)}</td></tr><tr><td>{_text(40 + 5 * k, True)}</td></tr><tr><td>{_a(12 + k)}</td></tr></table>{_links(2, 20)}",
        "divs": f"<div>{_a(3)}</div><div>{_text(2 + k)}</div><div>{_a(2)}</div>{_h(6)}{_p(some, long, some, long, tag='div')}<div>{_a(4)} {_a(6 + k)}</div><div>{_text(5)}</div>",
        "portal": f"{_links(8, 2 + k)}<div>{_a(30 + 10 * k)}</div>{_h(5)}{_p(some, some, some)}<div>{_a(50 + 10 * k)}</div>{_links(6, 8)}<div>{_text(4)} {_a(2)}</div>",
        "weave": f"<div>{_a(2)}</div>{_h(4)}<p>{_text(25, True)} {_a(15 + k)}</p>{_p(some)}<p>{_text(40, True)} {_a(20 + 3 * k)}</p>{_p(long)}{_links(4, 3)}",
        "index": f"<h2>{_text(2)}</h2>{_links(6, 3 + k)}<h2>{_text(2)}</h2>{_links(5, 10)}<p>{_text(3)} {_a(6)}</p>",
        "letter": f"<div>{_text(3)}</div><div>{_a(1)}</div>{_p(few, long, some)}<blockquote>{_text(some, True)}</blockquote>{_p(some)}<div>{_a(2)}</div><div>{_text(5 + k)}</div>",
        "tail": f"{_h(4)}{_p(some, some, long)}<h3>{_text(2)}</h3>{_links(4, 5 + k)}<h3>{_text(1)}</h3>{_links(2, 3)}<div>{_text(7)}</div>",
    }


def labelled_pages() -> dict[str, list[str]]:
    """Small pages by layout; the blocks that begin with "Main" are the main text."""
    return {name: [f"<body>{_layouts(k)[name]}" for k in range(6)] for name in _layouts(0)}


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, low, high) or a label."""
    if depth == 0 or y.min() == y.max():
        return (int(y.mean() >= 0.5),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            score = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if score < best[0] - 1e-12:
                best = (score, f, float(cut))
    if best[0] == np.inf:
        return (int(y.mean() >= 0.5),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: tuple, x: list[float]) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def train(pages: list[str] | None = None) -> tuple:
    pages = pages or [page for layout in labelled_pages().values() for page in layout]
    rows = [(f, text.startswith("Main")) for page in pages for text, f in blocks(page)]
    return grow(np.array([f for f, _ in rows]), np.array([y for _, y in rows], float))


def main_text(page: str | None, tree: tuple) -> str:
    return "\n".join(text for text, f in blocks(page) if decide(tree, f)) if page else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page (page_id, url, html).

    Main blocks are joined by one line end in page order; white space in a block is one
    blank; character references are decoded. Null, empty and textless pages give an
    empty text; a page is read whole, however long. Every row is judged by itself, also with
    a null id or if it is repeated; extra columns, of whatever names, are ignored. An empty
    table gives an empty result. Without sectioning elements the main text is told by
    lengths, links and names alone.
    """
    tree = train()

    def run(batches):
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
