"""Main text of web pages by tag-path ratios.

A page is read once into a tree of elements and its text blocks in page order. A block's tag path
is the names (and classes) from the root to its element. Per path, text length and punctuation are
totalled over its blocks and divided by their number; the two ratios are smoothed over neighbouring
blocks, fused by product, and thresholded by their deviation. Blocks of paths that pass select the
content: the elements that hold them (an article or main where the page names one; else the
nearest container, the deepest one with nearly all passing text, and what encloses them all below the body).
All blocks of the selected elements are kept, short ones as well.

Left out are elements that are no text of an article by their kind (menus, forms, scripts, ...), by
their role, or by a whole class or id of a fixed word list; but for readers' comments, an element of the list that
holds most of the page's text in passing paths is kept all the same. Time and memory are linear in a page, however
deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import lean, small_batches, steps, strings

# HTML element names and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
RCDATA = frozenset("title textarea".split())
DROPPED = RAW | frozenset("title textarea head svg annotation annotation-xml canvas audio video object map nav footer aside form button select option datalist dialog menu fieldset input label".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul br".split())
CONTENT = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes, where they are open (the optional end tags of HTML).
CLOSES_P = BLOCK - {"br", "html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option", "optgroup"}
SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("article main section div table td th ul ol dl aside nav footer header form blockquote button body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    ("ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget related recommended share sharing social follow footer footnav "
    "masthead topbar search skip").split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus responses".split())
#: Words that say nothing of what an element holds: beside these and numbers, words of the lists still count.
SHAPES = frozenset(
    ("area articles bar block box btn button buttons card cards container content global google group inner item items label leaderboard left link links list main mobile page panel post posts primary reader "
    "readers right secondary section site slot sticky stories thread top bottom unit user users wrap wrapper").split()
)
#: A header is the page's own, and no part of its content, beside these words only.
SITE_WORDS = frozenset("header bar container global inner main page site top wrap wrapper".split())
#: Ids that headings, paragraphs and sections have as the slug of their own title are not tested but for these.
PLAIN_IDS = frozenset("comments disqus_thread respond".split())
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"']|[\"'](?=[^<\"']*>))*)>|<[!?/][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，？！]")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
KEPT, LISTED, GONE = 0, 1, 2


def _listed(token: str, in_content: bool) -> int:
    """Whether a whole class or id is of the word lists: KEPT, LISTED, or GONE for readers' comments."""
    words = {x.lower() for x in PARTS.findall(token) if not x.isdigit()}
    if "header" in words:
        return LISTED if not in_content and words <= SITE_WORDS else KEPT
    if not words <= NOISE_WORDS | COMMENT_WORDS | SHAPES:
        return KEPT
    return GONE if words & COMMENT_WORDS else LISTED if words & NOISE_WORDS else KEPT


def _noise(name: str, attributes: str, in_content: bool) -> int:
    if name in DROPPED:
        return GONE
    if name == "header":
        return KEPT if in_content else GONE
    if not attributes.strip() or name in ("html", "body", "article", "main"):
        return KEPT
    out = KEPT
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES):
            return GONE
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return GONE
        if key == "id" and (name in HEADINGS or name in ("p", "section")):
            if value.lower() in PLAIN_IDS:
                return GONE
        elif key in ("class", "id"):
            out = max([out, *(_listed(x, in_content) for x in value.split())])
    return out


CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Page(NamedTuple):
    """Elements in page order (0 is the root): parent, name, path, content (the outermost article or main around it, or 0), listed (the outermost element of the word list around it, or 0); blocks: element, text."""

    parent: list[int]
    name: list[str]
    path: list[int]
    content: list[int]
    listed: list[int]
    blocks: list[tuple[int, str]]


def read(page: str) -> Page:
    """Text under boilerplate elements is not read; elements inside a line of text don't end a block and are not in paths."""
    out = Page([0], [""], [0], [0], [0], [])
    paths: dict[tuple[int, str], int] = {}
    # open elements: node (of the nearest element that is not inline), name, whether boilerplate
    stack: list[tuple[int, str, bool]] = [(0, "", False)]
    opened: Counter = Counter()
    held: list[str] = []
    at, end = 0, len(page)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.blocks.append((stack[-1][0], text))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][1] in BLOCK:
                flush()
            opened[stack.pop()[1]] -= 1

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            if not stack[-1][2]:
                held.append(page[at:])
            break
        if m.start() > at and not stack[-1][2]:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if not opened[name]:
                if name == "p":
                    flush()
                continue
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][1] == name:
                    pop_to(d)
                    break
                if stack[d][1] in BLOCK and name not in BLOCK:
                    break
            continue
        if name in CLOSES_P and opened["p"]:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][1] == "p":
                    pop_to(d)
                    break
                if stack[d][1] in SCOPE:
                    break
        if name in SELF:
            lowest = None
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][1] in SELF[name]:
                    lowest = d
                elif stack[d][1] in SCOPE and stack[d][1] not in ("td", "th"):
                    break
            if lowest:
                pop_to(lowest)
        node, _, gone = stack[-1]
        noise = GONE if gone else _noise(name, m[3], bool(out.content[node]))
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if name in RAW or name in RCDATA:
            close = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/") and name not in BLOCK and name not in INLINE:
            continue
        opened[name] += 1
        if name in INLINE:
            # too little to hold a page's text: listed is gone
            stack.append((node, name, noise != KEPT))
            continue
        known = CLASS.search(m[3])
        step = name + "".join(f".{c}" for c in sorted((known[1] or known[2] or known[3] or "").split())) if known else name
        new = len(out.parent)
        out.parent.append(node)
        out.name.append(name)
        out.path.append(paths.setdefault((out.path[node], step), len(paths) + 1))
        out.content.append(out.content[node] or (new if name in CONTENT and noise == KEPT else 0))
        out.listed.append(out.listed[node] or (new if noise == LISTED else 0))
        stack.append((new, name, noise == GONE))
    flush()
    return out


INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())


#: Elements that hold a piece of the content but are no containers of it.
LEAVES = HEADINGS | INLINE | {"p", "li", "ul", "ol", "td", "th", "tr", "tbody", "table", "dl", "dt", "dd", "blockquote", "pre", "header", "figure", "figcaption"}
ROOTS = frozenset({"html", "body"})


def path_scores(paths: list[int], texts: list[str]) -> np.ndarray:
    """The fused, smoothed ratio of each block: text and punctuation of all blocks of its path over their number."""
    _, which, n = np.unique(np.asarray(paths, np.int64), return_inverse=True, return_counts=True)
    ratio = (np.bincount(which, weights=[len(t) for t in texts]) / n)[which]
    marks = (np.bincount(which, weights=[len(PUNCTUATION.findall(t)) for t in texts]) / n)[which]
    kernel = np.array([1, 2, 4, 2, 1]) / 10
    if len(texts) >= len(kernel):
        weight = np.convolve(np.ones(len(texts)), kernel, "same")
        ratio, marks = (np.convolve(x, kernel, "same") / weight for x in (ratio, marks))
    return ratio * (1 + marks)


def passing(page: Page, of: list[int]) -> np.ndarray:
    """Whether each of these blocks (by number) has a path that passes."""
    score = path_scores([page.path[page.blocks[b][0]] for b in of], [page.blocks[b][1] for b in of])
    return score >= min(score.std(), score.max()) if len(score) else np.zeros(0, bool)


def _sums(parent: list[int], own: list[float]) -> list[float]:
    """Of each element, what it and all elements below it hold: children come after their parents."""
    out = list(own)
    for k in range(len(out) - 1, 0, -1):
        out[parent[k]] += out[k]
    return out


def _unlisted(page: Page) -> list[int]:
    """Blocks but those of the word list; an element of the list with most of all text, in several passing blocks, counts as unlisted."""
    if not any(page.listed):
        return list(range(len(page.blocks)))
    passed = passing(page, list(range(len(page.blocks))))
    total, held, many = 0, Counter(), Counter()
    for (node, text), ok in zip(page.blocks, passed):
        total += len(text)
        if ok:
            held[page.listed[node]] += len(text)
            many[page.listed[node]] += 1
    fine = {0} | {k for k, n in held.items() if 2 * n > total and many[k] >= 3}
    return [b for b, (node, _) in enumerate(page.blocks) if page.listed[node] in fine]


def selected(page: Page) -> list[int]:
    """The blocks (by number) of the content."""
    live = _unlisted(page)
    inside = [b for b in live if page.content[page.blocks[b][0]]]
    live = inside or live
    passed = [b for b, ok in zip(live, passing(page, live)) if ok]
    if not passed:
        return []
    keep = [False] * len(page.parent)
    # of each element, the nearest one around it that may contain others
    container = [0] * len(page.parent)
    for k in range(1, len(page.parent)):
        container[k] = page.content[k] or (container[page.parent[k]] if page.name[k] in LEAVES else k)
    own, met = [0.0] * len(page.parent), [0.0] * len(page.parent)
    for b in passed:
        node = page.blocks[b][0]
        own[node] += len(page.blocks[b][1])
        met[container[node]] += 1
    # the document's root, where it holds a block directly, stands for the block's own element
    top = [0] * len(page.parent)
    for k in range(1, len(page.parent)):
        root = page.name[page.parent[k]] in ROOTS or not page.parent[k]
        top[k] = k if root else top[page.parent[k]]
    for b in passed:
        node = page.blocks[b][0]
        c = container[node]
        keep[top[node] if page.name[c] in ROOTS or not c else c] = True
    weight, count = _sums(page.parent, own), _sums(page.parent, met)
    # the deepest element with nearly all passing text; the deepest that encloses all containers
    best = max((k for k in range(len(weight)) if weight[k] >= 0.95 * weight[0]), default=0)
    keep[container[best]] = True
    shared = max((k for k in range(len(count)) if count[k] == count[0]), default=0)
    if shared and page.name[shared] not in ROOTS:
        keep[shared] = True
    for k in range(1, len(keep)):
        keep[k] = keep[k] or keep[page.parent[k]]
    return [b for b in live if keep[page.blocks[b][0]]]


def main_text(page: str | None) -> str:
    """Blocks of the content in page order, one to a line; empty for null, empty or text-free pages."""
    if not page:
        return ""
    found = read(page)
    return "\n".join(found.blocks[b][1] for b in selected(found))


def extracted(pages: DataFrame, *, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns (or those in ``keep``) but the html, and its main text in ``text_col``, which replaces a column of that name.

    Rows are independent: null and empty html give an empty text, repeated rows repeat, very long
    and very deep pages are read whole; where paths tie at the threshold all of them pass. An
    empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    names = [c for c in (pages.columns if keep is None else keep) if c not in (text_col, html_col)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, html_col):
            texts = [main_text(x) for x in strings(b.column(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField(text_col, T.StringType())])
    return pages.select(*names, html_col).mapInArrow(lean(extract), schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) AS n_chars")
