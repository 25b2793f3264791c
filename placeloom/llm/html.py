"""HTML extraction by tree scoring.

Tags build a tree of containers; text between block boundaries is a block.  A block (headings apart) gives
points for its length and commas, discounted by its share of link text, to its container, and half, a third,
... of them to the containers above.  The best container, its own link density held against it, is kept whole
with those siblings that score high enough by themselves.  Of the article or main around them, else of their
parent, all that is not mostly links is kept too, headings and short blocks included, and a title that stands in a
box of its own before them.  Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts,
styles and comments never count, by tag, role, class or id; a paragraph named like a side box stays if it is prose.

Null and empty html give an empty text; unclosed and stray tags are closed or ignored; a page whose blocks all
are left out gives an empty text.  Texts of any length are kept whole.  Rows are judged one by one.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed tag sets.
RAW = frozenset("script style textarea noscript template title xmp iframe noembed noframes svg math".split())
DROPPED = frozenset("nav footer aside form button select option label fieldset menu dialog head object audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div header blockquote ul ol dl li dd td th tr table tbody thead tfoot figure figcaption details center address hgroup search".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre dt hr caption summary".split())
PARTS = frozenset("blockquote ul ol dl li dd figure figcaption details hgroup header".split())
OPTIONAL = frozenset("p li dt dd td th tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_word = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)
#: Words of class and id: of what is never text, of containers that are not (a paragraph by such a name may be prose), and of the page's head.
UNLIKELY = _word(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|comments?|disqus|sidebar|menu|nav\w*|breadcrumbs?|popup|modal|overlay|newsletter|subscribe|signup|login|pagination|pager|toolbar|skip")
ASIDE = _word(r"side|footer|share|sharing|social|related|recommend\w*|notice|alert|widget")
HEAD = _word(r"masthead|header")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form toolbar".split())
#: Characters beyond which a paragraph is prose.
PROSE = 80
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++)|(<)""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _judge(tag: str, attrs: str, inside: int) -> str:
    """Whether an element is to go ("drop"), is short of proof ("suspect": its text goes unless it is prose) or stays ("")."""
    if tag in DROPPED or (tag == "header" and not inside):
        return "drop"
    if not attrs.strip() or tag in ("body", "html", "article", "main"):
        return ""
    found = ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if UNLIKELY.search(value) or (ASIDE.search(value) and tag in CONTAINERS) or (HEAD.search(value) and tag in CONTAINERS and not inside):
                return "drop"
            if ASIDE.search(value) and tag in BLOCKS:
                found = "suspect"
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "drop"
    return found


class _Page:
    """The containers (parent, tag) and blocks (container, text, link share, tag of a heading or "")."""

    def __init__(self, html: str):
        self.parent, self.blocks = [-1], []
        self.tags = ["#root"]
        stack, dropped, drop_at = [0], [], None  # open containers; open tags below what is dropped
        words: list[str] = []
        linked, in_link, heading, suspect, articles = 0, 0, "", False, 0

        def flush():
            nonlocal words, linked
            if words:
                text = " ".join(unescape("".join(words)).split())
                share = min(1.0, linked / len(text)) if text else 0.0
                if text and not (suspect and (len(text) <= PROSE or share >= 0.25)):
                    self.blocks.append((stack[-1], text, share, heading))
            words, linked = [], 0

        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.match(html, at)
            at = m.end()
            text = m[7] or m[8]
            if text:
                if drop_at is None:
                    words.append(text)
                    if in_link:
                        linked += len(text.strip())
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
            if drop_at is not None and (
                drop_at in OPTIONAL and ((not closing and tag in (BLOCKS if drop_at == "p" else (drop_at,))) or (closing and tag in CONTAINERS and tag != drop_at))
                or tag == "body"
                or closing and tag == "html"
            ):
                drop_at, dropped = None, []  # its end tag was left out
            if drop_at is not None:
                # Inside something dropped: wait for its end, minding tags of the same name.
                if tag == drop_at:
                    if closing:
                        dropped.pop()
                        if not dropped:
                            drop_at = None
                    elif not attrs.endswith("/"):
                        dropped.append(tag)
                elif tag in RAW and not closing:
                    at = _past(html, tag, at)
                continue
            if tag in RAW:
                if not closing and not attrs.endswith("/"):
                    at = _past(html, tag, at)
                continue
            if closing:
                if tag == "a":
                    in_link = 0
                if tag in BLOCKS:
                    flush()
                    heading, suspect = "", False
                if tag in CONTAINERS:
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[i]] == tag:
                            articles -= sum(self.tags[x] in ("article", "main") for x in stack[i:])
                            del stack[i:]
                            in_link = 0
                            break
                continue
            verdict = _judge(tag, attrs, articles) if tag not in VOID else ""
            if tag in BLOCKS:
                flush()
                heading, suspect = tag if tag in HEADINGS else "", verdict == "suspect"
            elif tag == "br":
                words.append(" ")
            if verdict == "drop":
                if not attrs.endswith("/"):
                    flush()
                    drop_at, dropped = tag, [tag]
                continue
            if tag == "a":
                in_link = 1
            elif tag in CONTAINERS:
                if tag in ("li", "td", "th", "tr", "dd") and self.tags[stack[-1]] == tag:
                    stack.pop()
                self.parent.append(stack[-1])
                self.tags.append(tag)
                stack.append(len(self.parent) - 1)
                articles += tag in ("article", "main")
        flush()


def _past(html: str, tag: str, at: int) -> int:
    """Past the end tag of a raw element, or the end of the page."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
    return end.end() if end else len(html)


def extract(html: str | None) -> str:
    """The main text; blocks joined by line feeds."""
    page = _Page(html or "")
    if not page.blocks:
        return ""
    n = len(page.parent)
    score, chars, linked = [0.0] * n, [0] * n, [0.0] * n
    prose, prose_links = [0] * n, [0.0] * n  # without headings
    for node, text, share, heading in page.blocks:
        points = 0 if heading else (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - share)
        level = 1
        while node >= 0:
            score[node] += points / level
            chars[node] += len(text)
            linked[node] += share * len(text)
            if not heading:
                prose[node] += len(text)
                prose_links[node] += share * len(text)
            node, level = page.parent[node], level + 1
    final = [s * (1 - (k / c if c else 0)) for s, c, k in zip(score, chars, linked)]
    best = max(range(n), key=lambda i: (final[i], -i))
    kept = {best}
    for i in range(1, n):
        if i != best and page.parent[i] == page.parent[best] and final[i] >= max(10.0, 0.2 * final[best]):
            kept.add(i)
    # The whole that holds them: the article or main around, else their parent; a list or quotation is a part of what is around it.
    top = page.parent[best] if len(kept) > 1 else best
    around = top
    while around >= 0 and page.tags[around] not in ("article", "main"):
        around = page.parent[around]
    if around >= 0:
        top = around
    else:
        while page.tags[top] in PARTS:
            top = page.parent[top]
    out, title = [], None
    for node, text, share, heading in page.blocks:
        inside, plain, at = False, heading != "" or share < 0.5, node
        while at >= 0 and at != top:
            inside |= at in kept
            plain &= prose_links[at] < 0.5 * max(1, prose[at])
            at = page.parent[at]
        # Beside the best container, all of the whole but menus; and prose of their common parent.
        if inside or top in kept and at == top or at == top and plain or (node == page.parent[best] and not heading and len(text) > PROSE and share < 0.25):
            # Without an article or main, the title may stand in a box of its own before the text.
            if title is not None and not out and around < 0 and heading != "h1":
                out.append(title)
            out.append(text)
        elif heading == "h1" and share < 0.5:
            title = text
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
