"""Main text of web pages by line-block distribution.

Markup is stripped into one line per block.  Lines of menus, adverts, forms and the like count as
empty, so the lengths of text summed over a sliding window of lines surge where the article
begins and dive to nothing where it ends; the text between is kept whole.  Where a page marks its
articles, the marks take the place of the surge and the dive.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import prepare

#: Lines in a window, and the length of text in a window from which an article surges.
WINDOW, SURGE = 3, 86

#: Elements that end a block, whose text is no text, and whose text is never the article's.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template textarea iframe svg select button title noembed noframes xmp".split())
_ASIDE = frozenset("nav aside footer form menu dialog head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names, ids and roles of what surrounds an article: of what is never one itself,
#: of heads, which an article can have too, and the others.
_FOREIGN = frozenset("ad ads adv advert advertisement adverts comment comments commentlist consent cookie cookies disqus gdpr promo promoted promotion related replies reply respond sponsor sponsored".split())
_HEADS = frozenset("header masthead".split())
_AROUND = _FOREIGN | _HEADS | frozenset(
    "banner breadcrumb breadcrumbs contentinfo footer menu menubar modal nav navbar navigation newsletter notice notices overlay pagination popup share sharing sidebar signup social subscribe subscription toolbar widget".split()
)
#: Words that may stand beside them in a name; any other word ("has", "open") makes it another name.
_OWN = frozenset("article entry page post story".split())
_BESIDE = _OWN | frozenset(
    "area articles bar block body bottom box button buttons container content count form google group heading icon icons inner item items label left link links list main next posts prev previous primary right secondary section site slot sticky stories text thread title top unit wrap wrapper".split()
)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_OPEN_QUOTE = re.compile(r"""=\s*(["'])""")


def _tag_end(page: str, start: int, gone: set[str]) -> int:
    """Where the tag that begins at ``start`` ends; a ">" in a quoted value doesn't end it.

    ``gone`` holds the closing marks known to occur no more.
    """
    end = page.find(">", start)
    if end < 0 or "=" not in page[start:end]:
        return end
    at = start
    while (quote := _OPEN_QUOTE.search(page, at, end)) is not None:
        close = -1 if quote[1] in gone else page.find(quote[1], quote.end())
        if close < 0:
            gone.add(quote[1])
            return end
        if close > end:
            end = page.find(">", close)
            if end < 0:
                return end
        at = close + 1
    return end


def _is_around(attributes: str, in_article: bool) -> int:
    """Whether a name is that of surroundings: 0 no, 1 yes, 2 yes and never an article's."""
    found = 0
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORDS.findall(name)}
            around = words & _AROUND
            if not around or any(w not in _AROUND and w not in _BESIDE and len(w) > 1 for w in words):
                continue
            if not around <= _HEADS or not (in_article or words & _OWN):
                found = max(found, 2 if around & _FOREIGN else 1)
    return found


def lines(page: str, keep: frozenset[int] = frozenset()) -> tuple[list[tuple[str, bool, bool]], dict[int, tuple[int, int]]]:
    """Blocks of a page in order: (text, in an article, part of its surroundings).

    Also the elements that count as surroundings by their names alone, by where they begin: (length
    of the text in them, kind of name).  Those in ``keep`` don't count.
    """
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    at, size, article, linked = 0, len(page), 0, 0
    inside_link = False
    skip, depth = "", 0
    posts = seen = 0  # open <article> elements, length of all text
    named: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[tuple[int, int, int]]] = {}
    gone: set[str] = set()  # closing marks known to occur no more

    def end_block() -> None:
        nonlocal linked, seen
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                seen += len(line)
                out.append((line, article > 0, bool(skip) or (not article and linked > len(line) / 2)))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if inside_link:
                linked += len(piece)

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        add(page[at:mark])
        tag = _TAG.match(page, mark)
        if tag is None:
            if page.startswith("<!--", mark):
                end = -1 if "-->" in gone else page.find("-->", mark + 4)
                if end < 0:
                    gone.add("-->")
                    end = page.find(">", mark)
                at = size if end < 0 else end + (3 if page.startswith("-->", end) else 1)
            elif page.startswith(("<!", "<?"), mark):
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = mark + 1
            continue
        end = _tag_end(page, mark, gone)
        if end < 0:  # the page is cut inside this tag
            break
        name, closing = tag[1].lower(), page[mark + 1] == "/"
        at = end + 1
        if not closing and name in _RAW:
            shut = re.compile(f"</{name}\\b", re.IGNORECASE).search(page, at) if name not in gone else None
            if shut is None:
                gone.add(name)
                at = size if name in ("script", "style", "title") else at
            else:
                stop = page.find(">", shut.end())
                at = size if stop < 0 else stop + 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            inside_link = not closing
            continue
        if name not in _BLOCKS:
            continue
        end_block()
        inside_link = False
        around = 0
        if closing:
            if opened.get(name):
                start, before, kind = opened[name].pop()
                if kind:
                    named[start] = (seen - before, kind)
        elif name not in _VOID:
            # A page's article or main is that whatever its names; an article in another can be a comment.
            if name not in ("html", "body", "main", *_ASIDE) and (name != "article" or posts or skip):
                around = _is_around(page[tag.end() : end], article > 0)
            opened.setdefault(name, []).append((mark, seen, around))
            if mark in keep:
                around = 0
        if skip:
            if name in ("article", "main", "body") and not closing and skip != name and not around:
                skip = ""
            elif name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
                    out.extend([("", article > 0, False)] * WINDOW)
                continue
        if not skip and not closing and name not in _VOID and name not in ("html", "body"):
            if name in _ASIDE or (name == "header" and not article) or around:
                out.extend([("", article > 0, False)] * WINDOW)
                skip, depth = name, 1
                continue
        if name in ("article", "main") and not skip:
            out.extend([("", False, False)] * WINDOW)
            article = max(0, article - 1) if closing else article + 1
            if name == "article":
                posts = max(0, posts - 1) if closing else posts + 1
        elif name in ("section", "table"):
            out.append(("", article > 0, False))
    end_block()
    for stack in opened.values():
        named |= {start: (seen - before, kind) for start, before, kind in stack if kind}
    return out, named


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; "" if there is none.

    Where the page marks articles, every line inside them that isn't of their surroundings is kept,
    and none elsewhere.  An element that holds most of the page's text isn't left out for its names;
    one whose names are never an article's (comments can outweigh the article) only if there is
    other text.
    """
    page = page or ""
    found, named = lines(page)
    size = sum(len(text) for text, _, _ in found)
    most = {start: kind for start, (held, kind) in named.items() if 2 * held > size}
    if keep := frozenset(start for start, kind in most.items() if kind == 1):
        found, _ = lines(page, keep)
    text = _article(found)
    return text if text or len(keep) == len(most) else _article(lines(page, frozenset(most))[0])


def _article(found: list[tuple[str, bool, bool]]) -> str:
    marked = [text for text, inside, around in found if text and inside and not around]
    if marked:
        return "\n".join(marked)
    lengths = [0 if around else len(text) for text, _, around in found]
    sums = [0, *accumulate(lengths)]
    windows = [sums[min(len(lengths), i + WINDOW)] - sums[i] for i in range(len(lengths))]
    surge = min(SURGE, max(windows, default=0))
    kept: list[str] = []
    run: list[str] = []
    surged = empty = 0
    for (text, _, _), length, window in zip(found, lengths, windows, strict=True):
        if length:
            run.append(text)
            empty = 0
            surged = surged or window >= surge
        else:
            empty += 1
        if window == 0 and empty >= 1 and run:  # the dive: nothing in the next WINDOW lines
            kept += run if surged else []
            run, surged = [], 0
    return "\n".join(kept + (run if surged else []))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty pages have an empty text; null ids and urls stay; repeated rows each get a
    row; other columns are not read.
    """
    prepare(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
