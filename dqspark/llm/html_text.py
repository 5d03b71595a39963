"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score above zero, by how often words in such an element belong to the
labelled main part; tags score below zero, by how often they stand outside of it. One linear scan finds the contiguous
run with the highest total, whose blocks are the text. Labelled pages are those that mark one main part themselves.
Words in a marked main part count in full and its tags next to nothing, whichever they are. Parts that never belong to
the text are left out and score nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import sliced

#: Element names by their part in a page.
MAIN = frozenset({"article", "main"})
HIDDEN = frozenset({"script", "style", "noscript", "template", "title", "textarea", "select", "option", "svg", "math", "iframe", "object", "audio", "video", "canvas", "button"})
ASIDE = frozenset({"nav", "aside", "footer", "form", "menu", "dialog"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
})
INLINE = frozenset({"a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "input", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"})
_KNOWN = BLOCK | INLINE | VOID | {"head"}
#: Elements that only a new element of these ends.
_ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Names that mark what is no text, and words that go with them in compound names ("cookie-banner", "site_nav_links").
_ASIDE_NAMES = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|footer|masthead|menu|nav\w*|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|widget"
)
_BESIDE_NAMES = frozenset(
    "area articles bar block bottom box button buttons center container content desktop first form global group header icons inner item items last left link links list main mobile module outer page panel policy"
    " post posts primary right row secondary section site slot sticky text title top unit wrap wrapper".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.DOTALL)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.IGNORECASE) for tag in HIDDEN}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if tag in MAIN or tag in ("body", "html"):
        return False
    return bool(attributes) and any(_aside_name(name) for _, a, b, c in _NAMES.findall(attributes) for name in (a or b or c).lower().split())


def _aside_name(name: str) -> bool:
    """Whether all words of a name are of the two lists, one at least of the first: "sidebar-left", not "no-sidebar"."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    named = [bool(_ASIDE_NAMES.fullmatch(w)) for w in words]
    return any(named) and all(n or w in _BESIDE_NAMES for n, w in zip(named, words, strict=True))


def tokens(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, value, element, in main part, in a part that never belongs to the text) of a page, in order.

    kind is "text" with its source text, "open" or "close" with the tag. Comments and hidden elements give nothing.
    element is the innermost open block; what its end tag does not close, the end of an outer element closes.
    """
    opened: list[tuple[str, bool]] = []
    places: dict[str, list[int]] = {}  # of each open tag in opened, so that no step walks over all that is open
    blocks = ["body"]
    at, size, aside, main = 0, len(page), 0, 0

    def shut(to: int) -> None:
        nonlocal aside, main
        while len(opened) > to:
            tag, was_aside = opened.pop()
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            aside -= was_aside
            main -= tag in MAIN

    while at < size:
        found = _TAG.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            yield "text", page[at:stop], blocks[-1], main > 0, aside > 0
        if not found:
            return
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag in HIDDEN and not found[1]:
            if found[3].rstrip().endswith("/"):
                continue
            end = _CLOSE[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        known = tag if tag in _KNOWN else "other"
        if found[1]:
            yield "close", known, blocks[-1], main > 0, aside > 0
            if places.get(tag):
                shut(places[tag][-1])
            continue
        if tag in _ENDS_P and places.get("p"):
            shut(places["p"][-1])
        if tag not in VOID and not found[3].rstrip().endswith("/"):
            own = _aside(tag, found[3]) or (tag == "header" and not main)
            places.setdefault(tag, []).append(len(opened))
            opened.append((tag, own))
            if tag in BLOCK:
                blocks.append(tag)
            aside += own
            main += tag in MAIN
        yield "open", known, blocks[-1], main > 0, aside > 0


def labelled(found: list[tuple[str, str, str, bool, bool]]) -> bool:
    """Whether the tokens of a page mark one main part."""
    return sum(kind == "open" and value in MAIN and not aside for kind, value, _, _, aside in found) == 1


def _tag(value: str, element: str) -> str:
    return f"tag {value} in p" if value in INLINE and element == "p" else f"tag {value}"


def token_counts(page: str) -> Counter:
    """How often each kind of word and tag stands inside (True) and outside of the main part of a labelled page, without
    the parts that never belong to the text."""
    out: Counter = Counter()
    found = list(tokens(page))
    if not labelled(found):
        return out
    for kind, value, element, main, aside in found:
        if aside:
            continue
        if kind == "text":
            out["word " + element, main] += len(value.split())
        else:
            out[_tag(value, element), main] += 1
    return out


def fit_weights(pages: DataFrame, penalty: float = 4.0) -> dict[str, float]:
    """Scores of words by enclosing block and of tags, inline tags apart in paragraphs, from all labelled pages. There is
    a count or two per known element. They hold outside of marked main parts.

    A word scores the smoothed share of such words inside; a tag minus penalty times its smoothed share outside, so that
    no tag outweighs more than penalty words. Without labelled pages every word scores a half.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in sliced(stream):
            for page in batch.column(0).to_pylist():
                total.update(token_counts(page or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            names=["token", "inside", "n"],
        )

    counted = pages.select("html").mapInArrow(batches, "token string, inside boolean, n long")
    counted = counted.groupBy("token").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n"))
    weights = {}
    for token, inside, n in counted.collect():
        share = (inside + 1) / (n + 2)
        weights[token] = share if token.startswith("word ") else -0.01 - penalty * max(0.0, 1 - share - 0.05)
    return weights


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best-scoring run of words and tags, two line feeds between them. Null, empty and wordless pages
    give an empty text. Of equally good runs the first one is taken, and of those the longest."""
    blocks: list[list[str]] = [[]]
    best = (0.0, 0, 0)
    total, first, parts = 0.0, 0, []
    found = list(tokens(page or ""))
    # What stands outside of the one main part of a labelled page is no text, whatever it looks like.
    marked = labelled(found) and any(kind == "text" and main and not aside and value.split() for kind, value, _, main, aside in found)
    for kind, value, element, main, aside in found:
        if kind == "text":
            n = len(value.split())
            if aside:
                continue
            if n and total <= 0:
                total, first = 0.0, len(parts)
            parts.append(value)
            total += n * (1.0 if main else -1.0 if marked else weights.get("word " + element, 0.5))
            if n and total > best[0]:
                best = (total, first, len(parts))
        else:
            if value in BLOCK:
                parts.append(None)
            elif value == "br":
                parts.append("\n")
            if not aside:
                total += -0.01 if main else weights.get(_tag(value, element), -0.05)
    for part in parts[best[1] : best[2]]:
        if part is None:
            blocks.append([])
        else:
            blocks[-1].append(html.unescape(part))
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points). Repeated rows and null ids stay as they are;
    other columns are not read. weights come from fit_weights; by default they are fitted on these pages."""
    shared = pages.sparkSession.sparkContext.broadcast(fit_weights(pages) if weights is None else weights)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(stream):
            texts = [main_text(page, shared.value) for page in batch.column(2).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
