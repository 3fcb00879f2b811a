"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of block elements from the root.  Blocks
inside elements that are never content (menus, forms, adverts, comments and so on, by tag or by
a whole class, id or role) are left out; an element that only its name or a form calls so stays
if it holds the page's article or most of the page's text (not comments, and nothing that stands
beside an article).  For every path the text length and the punctuation of its blocks are
summed and divided by the number of blocks; both ratios are smoothed along the order in which
the paths first appear, multiplied, and compared with a threshold from their spread.  The
elements that hold the chosen paths are the content: all their blocks are returned in order.
The page's body counts as such an element only where no other holds more of the chosen text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML elements by role
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object canvas audio video select".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var img br wbr picture source input".split()
)
NEVER = set("nav footer aside menu dialog button head".split())
FORMS = set("form fieldset".split())
HEADINGS = set("p h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("article main".split())
# fixed values: whole classes and ids that name what is not content
COMMENTS = set("comments comment-list commentlist comments-list comments-area comment-section comment-form disqus_thread".split())
NEVER_NAMES = COMMENTS | set(
    "ad ads adv advert adverts advertisement ad-container ad-wrapper sponsored-links sidebar cookie-notice cookie-banner "
    "cookie-consent cookie-bar newsletter-signup breadcrumb breadcrumbs pagination social-share share-buttons "
    "sharedaddy related-posts related-articles skip-link".split()
)
# outside of article and main also these
CHROME_NAMES = set(
    "nav navbar navigation main-nav main-menu menu header site-header masthead footer site-footer toolbar".split()
)
NEVER_ROLES = set("navigation menu menubar banner search contentinfo complementary dialog alertdialog toolbar".split())
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr main menu nav ol p pre section table ul".split()
)
_CLOSES_SELF = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "p": {"p"},
}
_SCOPES = set("ul ol dl table article main section div body html blockquote td th".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟।¿¡]")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    content: bool  # not inside an element that is never content


@dataclass
class Doubt:
    """An element that its name, a form or hiding calls no content."""

    comments: bool
    inside: bool  # of an article or main
    length: int = 0  # of its text
    article: int = 0  # of the text of the longest article or main in it


def _attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), value.strip("\"'") if value[:1] in ("'", '"') else value)
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    style = (d.partition(":") for d in attributes.get("style", "").lower().split(";"))
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or any(k.strip() == "display" and v.replace("!important", "").strip() == "none" for k, _, v in style)
    )


def page_blocks(source: str) -> list[Block]:
    """Blocks of text in page order, white space collapsed, character references decoded.

    Broken markup is read as browsers do in common cases: a block closes an open paragraph,
    list items and cells close each other, end tags without a start are passed over, and what
    is left open ends with the page.
    """
    blocks: list[Block] = []
    # tag, tag with its class, content, doubts about it and what is round it, containers round it
    stack: list[tuple[str, str, bool, tuple[Doubt, ...], tuple[int, ...]]] = []
    doubts_of: list[tuple[Doubt, ...]] = []  # of each block
    articles: list[tuple[int, tuple[Doubt, ...]]] = []  # length of text, doubts round the article or main
    total = outside = 0  # length of all text, and of that in article or main without doubts
    pieces: list[str] = []

    def flush() -> None:
        nonlocal total, outside
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                _, _, content, doubts, containers = stack[-1] if stack else ("", "", True, (), ())
                blocks.append(Block(tuple(s[1] for s in stack), text, content))
                doubts_of.append(doubts)
                if content:
                    total += len(text)
                    outside += len(text) if containers and not doubts else 0
                    for d in doubts:
                        d.length += len(text)
                    for i in containers:
                        articles[i] = (articles[i][0] + len(text), articles[i][1])

    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            pieces.append(source[at:])
            break
        pieces.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag in _CLOSES_P and any(s[0] == "p" for s in stack):
            depth = max(i for i, s in enumerate(stack) if s[0] == "p")
            if not any(s[0] in _SCOPES for s in stack[depth + 1 :]):
                del stack[depth:]
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in _CLOSES_SELF.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in _SCOPES and stack[i][0] not in ("td", "th"):
                break
        if tag in VOID:
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        names = [n.lower() for k, v in attributes.items() if k in ("class", "id", "role") for n in v.split()]
        tokens = {n.lower() for k in ("class", "id") for n in attributes.get(k, "").split()}
        content, doubts, containers = stack[-1][2:] if stack else (True, (), ())
        never = tag in NEVER or (tag == "header" and not containers)
        named = tokens & NEVER_NAMES or (not containers and tokens & CHROME_NAMES)
        named = named or attributes.get("role", "").strip().lower() in NEVER_ROLES
        reply = tag in CONTAINERS and any(n.split("-")[0].split("_")[0] in ("comment", "comments", "reply") for n in tokens)
        doubtful = (named and tag not in HEADINGS) or reply or tag in FORMS or _hidden(attributes)
        if doubtful and tag not in ("html", "body"):
            doubts = (*doubts, Doubt(reply or bool(tokens & COMMENTS), bool(containers)))
        if tag in CONTAINERS:
            # a doubt about an article itself is not settled by its being one
            articles.append((0, stack[-1][3] if stack and not reply else ()))
            containers = (*containers, len(articles) - 1)
        label = f"{tag}.{names[0]}" if names else tag
        stack.append((tag, label, content and not never, doubts, containers))
    flush()
    for length, doubts in articles:
        for d in doubts:
            d.article = max(d.article, length)

    def stays(d: Doubt) -> bool:
        return d.article > outside or (not d.comments and 2 * d.length > total and (d.inside or not outside))

    for block, doubts in zip(blocks, doubts_of, strict=True):
        block.content = block.content and all(stays(d) for d in doubts)
    return blocks


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    """Gaussian mean over neighbours."""
    kernel = [math.exp(-(d * d) / 2) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + radius], values[i + d]) for d in range(-radius, radius + 1) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def content_paths(blocks: list[Block], spread: float = 0.5) -> set[tuple[str, ...]]:
    """Paths whose fused ratio reaches ``spread`` times the standard deviation; the best one at least."""
    length: dict[tuple[str, ...], int] = {}
    stops: dict[tuple[str, ...], int] = {}
    count: dict[tuple[str, ...], int] = {}
    for b in blocks:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        stops[b.path] = stops.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
    paths = list(length)
    if not paths:
        return set()
    text_ratio = _smooth([length[p] / count[p] for p in paths])
    stop_ratio = _smooth([(1 + stops[p]) / count[p] for p in paths])
    # a path's own text keeps a short heading next to long paragraphs from taking their place
    fused = [t * s * math.log1p(length[p]) for t, s, p in zip(text_ratio, stop_ratio, paths, strict=True)]
    mean = sum(fused) / len(fused)
    limit = spread * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    top = max(fused)
    return {p for p, f in zip(paths, fused, strict=True) if f >= limit or f == top}


def _holder(path: tuple[str, ...]) -> tuple[str, ...]:
    """The element that holds a path's blocks: the outermost article or main, else the parent of
    the innermost paragraph-like element."""
    for i, label in enumerate(path):
        if label.split(".")[0] in CONTAINERS:
            return path[: i + 1]
    end = len(path)
    while end > 1 and path[end - 1].split(".")[0] in (
        "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "td", "th", "tr", "tbody",
        "table", "dl", "dt", "dd", "figure", "section",
    ):
        end -= 1
    return path[:end]


def main_text(source: str | None, spread: float = 0.5) -> str:
    """Blocks of the article joined by an empty line; empty for a null, empty or bare page."""
    blocks = [b for b in page_blocks(source or "") if b.content]
    weight: dict[tuple[str, ...], int] = {}
    chosen = content_paths(blocks, spread)
    for b in blocks:
        if b.path in chosen:
            weight[_holder(b.path)] = weight.get(_holder(b.path), 0) + len(b.text)
    if not weight:
        return ""
    most = max(weight.values())
    # the body holds the whole page: beside an element with more chosen text it adds its own blocks only
    loose = {h for h, w in weight.items() if w < most and (not h or h[-1].split(".")[0] in ("html", "body"))}
    holders = set(weight) - loose
    kept = [
        b.text
        for b in blocks
        if any(b.path[: len(h)] == h for h in holders) or (b.path in chosen and _holder(b.path) in loose)
    ]
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", spread: float = 0.5) -> DataFrame:
    """All columns of ``pages`` but ``html_col``, then ``text_col`` with the page's main text.

    A null or empty page, or one without content, has an empty text.  A column that has the
    name of the text is replaced.
    """
    names = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*names, F.col(html_col).alias("__html"))
    schema = pages.select(*names, F.lit("").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), spread) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, text_col]
            )

    return rows.mapInArrow(run, schema)
