"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element.  Each line has a
length, and each position the sum of the lengths in a sliding window of lines.
Where that sum surges over a threshold the main text starts; where the windows
fall under it again, or the text stops, it ends.  What lies between a surge and
its dive is kept.  The threshold follows the page: with M its largest window, it
is ``threshold * M / (M + threshold)``, so it is always under the peak.

One rule for all pages; what the markup says only weighs the lines:

* text in links counts nothing, but inside an article mark (article, main, or a
  role, itemprop or class that says so), where a line counts its whole length
  and ``threshold`` more;
* the more of the page's text is marked, the less a line outside counts: its
  length times (1 - share)^2, the share being that of the marked lines' lengths;
* containers whose class or id names something that can be either (legal, alert,
  notice, share, related, tags, widget ...) count a quarter, without the mark,
  and those named as adverts, newsletters or cookie banners a sixteenth;
* nav, header, footer, aside, form and the like, scripts and styles, and
  containers named as menus or reader comments are never text.  Where a container that is so named for its place in the layout
  holds more than half of the page's text, it is the page's frame, and is read.

A change of mark or of weight is a gap of one window, so what stands beside the
article neither lifts nor lengthens it.

Edge cases: null or empty html, and pages with no text, give an empty text;
character references are decoded (unknown ones stay); unclosed tags, comments
and attributes end with the page; only white space inside a block is changed;
equal lines are each kept; very long pages are read whole (an Arrow batch is
bounded by bytes, or holds one page); rows that repeat are each extracted, an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "title", "xmp", "noframes", "noembed", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "fieldset", "label", "datalist", "option", "figcaption-none"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_NAME = r"(?:^|[\s_-])(?:%s)(?=$|[\s_-]|\d)"
#: Never text: reader comments.
NEVER = re.compile(_NAME % "comments?|commentlist|comment-list|disqus|respond|replies|reader-comments|discussion", re.I)
#: Hardly ever text: adverts and banners.
RARE = re.compile(_NAME % "ads?|adverts?|advertisement|advertising|adsense|adslot|banner|sponsor(?:ed)?|cookies?|consent|gdpr|popup|pop-up|newsletter|subscribe|subscription|signup|sign-up|outbrain|taboola", re.I)
#: Never text, but where it frames the page: names of places in the layout.
LAYOUT = re.compile(_NAME % "promo(?:tion|ted)?|sidebar|side-bar|menu|menubar|nav|navbar|navigation|breadcrumbs?|topbar|toolbar|masthead|site-?header|page-?header|site-?footer|page-?footer|footer|foot|header|notification|modal|overlay|paywall|login|social|pagination|pager|skip|skip-link|hidden", re.I)
#: Text if there is much of it.
MAYBE = re.compile(_NAME % "notices?|alert|share|sharing|related|recommended|recommendations|more-stories|widget|tags|taglist|copyright|legal|disclaimer", re.I)
#: Names that only say what a container has, or hasn't.
ABOUT = re.compile(r"(?:^|\s)(?:has|with|without|no|is|js)[_-]\S+", re.I)
JUNK_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "status"}
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?body|post-?content|entry-?content|article-?content|main-?content|story-?body|articlebody)(?=$|[\s_-])", re.I)
LIST_ITEM = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


OK, SOME, FEW, NONE = range(4)
SHARE = {SOME: 1 / 4, FEW: 1 / 16}


def _kind(tag: str, attrs: dict[str, str]) -> tuple[int, bool]:
    """(whether an element's text counts, whether only its place in the layout says so)."""
    if tag in DROP:
        return NONE, False
    if tag in ("body", "html", "article", "main"):
        return OK, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in JUNK_ROLE:
        return NONE, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return NONE, False
    names = [ABOUT.sub(" ", v) for k in ("class", "id") if (v := attrs.get(k)) and not MAIN_WORDS.search(v)]
    if any(map(NEVER.search, names)):
        return NONE, False
    if any(map(LAYOUT.search, names)):
        return NONE, True
    if any(map(RARE.search, names)):
        return FEW, False
    return (SOME if any(map(MAYBE.search, names)) else OK), False


def _is_main(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody":
        return True
    return bool(MAIN_WORDS.search(attrs.get("class", "")) or MAIN_WORDS.search(attrs.get("id", "")))


def lines_of(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, characters outside links, kind, article mark or -1, layout container or -1, named container) of each block."""
    out: list[tuple[str, int, int, int, int, int]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, int, int, int, int]] = []  # tag, kind, article mark, layout container, named container
    marks, frames, parts, at, n, anchors = 0, 0, 0, 0, len(page), 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, max(0, len(line) - linked), *(stack[-1][1:] if stack else (OK, -1, -1, 0))))
            text.clear()
        linked = 0

    def emit(raw: str) -> None:
        nonlocal linked
        if raw:
            s = _html.unescape(raw) if "&" in raw else raw
            text.append(s)
            if anchors:
                linked += len(" ".join(s.split()))

    def pop_to(i: int) -> None:
        nonlocal anchors
        while len(stack) > i:
            if stack.pop()[0] == "a":
                anchors -= 1

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            emit(page[at:])
            break
        emit(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                emit(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCK or any(s[0] in BLOCK for s in stack[i:]):
                        if tag not in BLOCK:  # an inline end tag doesn't close blocks
                            break
                        flush()
                    pop_to(i)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            if tag in LIST_ITEM:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag or (tag in ("td", "th") and stack[i][0] in ("td", "th")) or (tag in ("dt", "dd") and stack[i][0] in ("dt", "dd")):
                        pop_to(i)
                        break
                    if stack[i][0] in LIST_ITEM[tag]:
                        break
        if m[0].endswith("/>") and tag not in BLOCK:
            continue
        raw = m[3]
        attrs = _attributes(raw) if raw and not raw.isspace() else {}
        was, mark, frame, part = stack[-1][1:] if stack else (OK, -1, -1, 0)
        # a heading block inside an article is the article's own
        kind, layout = (OK, False) if mark >= 0 and tag == "header" else _kind(tag, attrs)
        if kind > was and tag not in BLOCK:
            flush()
        if kind > was:
            parts += 1
            part = parts
        if kind == NONE and was < NONE and layout:
            frame, frames = frames, frames + 1
        elif kind == NONE and not layout:
            frame = -1
        if mark < 0 and kind == OK and _is_main(tag, attrs):
            mark, marks = marks, marks + 1
        stack.append((tag, max(kind, was), mark, frame, part))
        if tag == "a":
            anchors += 1
    flush()
    return out


def main_text(page: str | None, window: int = 3, threshold: int = 86) -> str:
    """The main text of a page: blocks joined by an empty line."""
    if not page:
        return ""
    lines = lines_of(page)
    lengths, at = weighted(lines, window, threshold)
    keep = distribution(lengths, window, threshold)
    return "\n\n".join(line for (line, *_), k in zip(lines, at, strict=True) if keep[k])


def weighted(lines: list[tuple], window: int, threshold: int) -> tuple[list[float | None], list[int]]:
    """(the lengths that lines count for, gaps between, None: never text; where each line is among them)."""
    total, framed = 0, {}
    for _, n, kind, _, frame, _ in lines:
        if kind < NONE or frame >= 0:
            total += n
        if frame >= 0:
            framed[frame] = framed.get(frame, 0) + n
    kinds = [OK if frame >= 0 and 2 * framed[frame] > total else kind for _, _, kind, _, frame, _ in lines]
    marked = sum(len(line) + threshold for (line, _, _, mark, *_), kind in zip(lines, kinds, strict=True) if mark >= 0 and kind == OK)
    beside = sum(n for (_, n, _, mark, *_), kind in zip(lines, kinds, strict=True) if mark < 0 and kind < NONE)
    outside = (beside / (marked + beside)) ** 2 if marked else 1.0
    lengths: list[float | None] = []
    at, last = [], None
    for (line, n, _, mark, _, part), kind in zip(lines, kinds, strict=True):
        here = (mark >= 0, kind, part)
        if last is not None and here != last:
            lengths += [None] * window
        last = here
        at.append(len(lengths))
        if kind == NONE:
            lengths.append(None)
        elif kind in SHARE:
            lengths.append(n * SHARE[kind] * (1.0 if mark >= 0 else outside))
        else:
            lengths.append(float(len(line) + threshold) if mark >= 0 else n * outside)
    return lengths, at


def distribution(length: list[float | None], window: int, threshold: float) -> list[bool]:
    """Which lines lie between a surge and a dive; None: a line that is never kept."""
    n = len(length)
    own = [x or 0 for x in length]
    sums = [sum(own[i : i + window]) for i in range(n)]
    most = max(sums, default=0)
    limit = threshold * most / (most + threshold) if most else 0
    keep = [False] * n
    i = 0
    while i < n:
        if own[i] == 0 or sums[i] <= limit:
            i += 1
            continue
        # surge: window i is over the limit and starts with text
        j = i
        while j < n and length[j] is not None and (own[j] or sums[j]) and sum(own[max(0, j - window + 1) : j + window]) > limit:
            j += 1
        for k in range(i, j):
            keep[k] = own[k] > 0
        i = max(j, i + 1)
    return keep


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.select(id_col).schema[0].dataType.simpleString()

    def run(ids, urls, bodies):
        for i, u, h in zip(ids, urls, bodies, strict=True):
            t = main_text(h)
            yield (i, u, t, len(t))

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_rows(src, run, f"page_id {kind}, url string, text string, n_chars bigint")
