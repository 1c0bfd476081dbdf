"""Main text of HTML pages by tree scoring.

Block elements form a tree. Every paragraph of text earns points for its length and its commas and
passes them to its ancestors, less to each further one; a container's points are discounted by the
share of its text that is links. The container with the most points is kept with the siblings that
look like part of the same article. Chrome (menus, footers, forms and the like) is left out first.
"""

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from letterloom.llm.common import annotate, free_name

EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

BLOCK_TAGS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary "
    "center hgroup menu search dialog hr legend".split()
)
#: Elements whose content is never text of the page.
RAW_TAGS = "script|style|noscript|template|svg|math|iframe|object|textarea|select|head|title|canvas|audio|video|button"
CHROME_TAGS = frozenset("nav footer aside form menu search dialog fieldset".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split()
)
#: Words of class or id that mark chrome wherever they stand, and those that a word of CONTENT outweighs.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments "
    "disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription signup login "
    "popup modal overlay share sharing social breadcrumb breadcrumbs pagination pager notice notices "
    "banner outbrain taboola recommended recommendations paywall".split()
)
LAYOUT_WORDS = frozenset(
    "nav navbar navigation menu menus sidebar sidebars footer header masthead topbar toolbar widget widgets related "
    "search skip tags rail aside alert".split()
)
CONTENT = frozenset("article content main story text body entry post page".split())
KEPT_TAGS = frozenset("html body main article".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "tfoot": frozenset(["tr", "td", "th", "tbody"]),
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset(["hr"])
LEVELS = 6

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "first", "last", "points", "weight")

    def __init__(self, tag, parent, dropped, first, weight):
        self.tag, self.parent, self.dropped, self.first, self.weight = tag, parent, dropped, first, weight
        self.children, self.last, self.points = [], first, 0.0


def _chrome(tag: str, tag_text: str, in_article: bool) -> tuple[bool, float]:
    """Whether the element is chrome, and the points its names add as a container."""
    if tag in CHROME_TAGS or (tag == "header" and not in_article):
        return True, 0.0
    marks: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(tag_text[len(tag) + 1 :]):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return tag not in ("html", "body"), 0.0
        if name == "style":
            if HIDDEN.search(value) and tag not in ("html", "body"):
                return True, 0.0
        elif name == "role":
            if value.lower() in CHROME_ROLES and tag not in KEPT_TAGS:
                return True, 0.0
            if value.lower() in ("main", "article"):
                marks.add("main")
        elif value:
            marks |= {w.lower() for w in WORDS.findall(value)}
    content = bool(marks & CONTENT)
    if marks & CHROME_WORDS and (tag not in KEPT_TAGS or (tag == "article" and marks & {"comment", "comments"})):
        return True, 0.0
    if tag not in KEPT_TAGS and marks & LAYOUT_WORDS and not content and tag not in HEADINGS:
        return not (in_article and marks & {"header", "tags"}) or "sidebar" in marks, 0.0
    return False, 25.0 * content


def _parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Block elements in page order, and runs of text between block borders: (element, text, link chars)."""
    root = Node("html", None, False, 0, 0.0)
    nodes, runs, stack = [root], [], [root]
    parts: list[str] = []
    linked, link_chars = False, 0

    def flush():
        nonlocal link_chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                runs.append((stack[-1], text, min(link_chars, len(text))))
            parts.clear()
        link_chars = 0

    def close(upto: int):
        nonlocal linked
        flush()
        while len(stack) > upto:
            stack.pop().last = len(runs)
        linked = False

    for match in TOKEN.finditer(page):
        token = match.group()
        if token[0] != "<" or len(token) == 1:
            if not stack[-1].dropped:
                parts.append(token)
                if linked:
                    link_chars += len(token.strip())
            continue
        if match.group(1) or token.startswith(("<!", "<?")):
            continue
        named = NAME.match(token)
        if not named:
            continue
        tag, ending = named.group(1).lower(), token[1] == "/"
        if tag == "a":
            linked = not ending
        elif tag in ("br", "wbr", "img", "input"):
            if tag == "br":
                parts.append(" ")
        elif tag not in BLOCK_TAGS:
            continue
        elif ending:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            else:
                flush()
        elif tag in ("html", "body") and len(stack) > 1 and any(n.tag == tag for n in stack[1:]):
            continue
        else:
            if stack[-1].tag == "p" or stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
            for depth in range(len(stack) - 1, 0, -1):
                above = stack[depth].tag
                if above in CLOSED_BY.get(tag, ()):
                    close(depth)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif above in SCOPES.get(tag, {"table"}) or tag not in CLOSED_BY:
                    break
            flush()
            if tag in VOID:
                continue
            parent = stack[-1]
            in_article = any(n.tag == "article" for n in stack)
            dropped, weight = (True, 0.0) if parent.dropped else _chrome(tag, token, in_article)
            node = Node(tag, parent, dropped, len(runs), weight)
            parent.children.append(node)
            nodes.append(node)
            stack.append(node)
    close(0)
    return nodes, runs


def main_text(page: str) -> str:
    """Text of the article of one page: blocks in page order, one a line."""
    nodes, runs = _parse(page)
    if not runs:
        return ""
    chars, links = [0], [0]
    for node, text, linked in runs:
        chars.append(chars[-1] + len(text))
        links.append(links[-1] + linked)
        points = min(len(text) / 25, 1.0) + text.count(",") + min(len(text) / 100, 3.0)
        points *= 1.0 - linked / len(text)
        # a paragraph's own element is not a container
        up = node.parent if node.tag in ("p", "li", "pre", "td", "blockquote") and node.parent else node
        for level in range(LEVELS):
            if up is None:
                break
            up.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            up = up.parent

    def density(node: Node) -> float:
        total = chars[node.last] - chars[node.first]
        return (links[node.last] - links[node.first]) / total if total else 0.0

    def worth(node: Node) -> float:
        return (node.points + (node.weight if node.points else 0.0)) * (1.0 - density(node))

    scored = [n for n in nodes if not n.dropped and n.tag not in HEADINGS and n.last > n.first]
    best = max(scored, key=lambda n: (worth(n), -n.first), default=nodes[0])
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    best = up or best
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        least = max(10.0, 0.2 * worth(best))
        for other in best.parent.children:
            if other is best or other.dropped or other.last == other.first:
                continue
            size = chars[other.last] - chars[other.first]
            if (
                other.tag in HEADINGS
                or worth(other) >= least
                or (other.tag in ("p", "pre", "blockquote") and density(other) < 0.25 and size > 0)
            ):
                kept.append(other)
    wanted = sorted((n.first, n.last) for n in kept)
    # lists and boxes inside the article that are all links are menus
    menus = [
        (n.first, n.last)
        for n in nodes
        if n.tag in ("ul", "ol", "div", "section", "table")
        and n not in kept
        and n.last - n.first >= 3
        and density(n) > 0.9
    ]
    out = []
    for first, last in wanted:
        for i in range(first, last):
            if not any(a <= i < b for a, b in menus):
                out.append(runs[i][1])
    return "\n".join(out)


def _extractor():
    def extract(pages: list[bytes]):
        found = [main_text(p.decode(errors="replace")) for p in pages]
        return found, [len(t) for t in found]

    return extract


def extract_text(pages: DataFrame, html: str = "html", name: str = "main") -> DataFrame:
    """`pages` with a struct column: text (blocks of the article, one a line) and n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, ends are trimmed,
    empty blocks go. Null or empty pages and pages without text give ''. Of containers with equal
    points the first counts. Extra columns are kept; `name` gets underscores if it is taken.
    """
    return annotate(pages, html, EXTRACTED, lambda: _extractor(), free_name(pages, name))
