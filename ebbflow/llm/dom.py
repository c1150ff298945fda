"""A small tolerant HTML reader: block elements as a tree, inline markup as text."""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
BREAKS = frozenset("br hr wbr".split()) - {"wbr"}
#: tag -> (open elements that it closes, elements beyond which it does not look)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
PARAGRAPH = (frozenset(["p"]), BLOCKS - {"p"})

#: Elements that are never part of a page's main text.
ASIDE_TAGS = frozenset("head nav footer aside form button dialog menu label fieldset".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar aside ad ads adv advert adverts advertisement advertising adsense banner"
    " sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription popup modal"
    " overlay comment comments commentlist disqus respond replies related recommended recommendations share sharing social"
    " breadcrumb breadcrumbs footer masthead login signup search pagination pager widget toolbar".split()
)
#: Words of a class or id that say the element holds the text, whatever else it says.
MAIN_WORDS = frozenset("main content article post entry story body text".split())
#: Page headers; inside an article they hold its title.
HEADER_WORDS = frozenset(["header"])
KEEPERS = frozenset(["html", "body", "main", "article"])


class Node:
    """A block element, or one that is set apart: its parts are strings and nodes."""

    __slots__ = ("aside", "label", "parent", "parts", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, aside: bool):
        self.tag, self.label, self.parent, self.aside = tag, label, parent, aside
        self.parts: list[str | Node] = []

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if type(x) is Node]


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}


def set_apart(tag: str, held: dict[str, str], in_article: bool) -> bool:
    """Whether an element is a menu, notice, advert or the like by its tag, role or names."""
    if tag in ASIDE_TAGS or "hidden" in held:
        return True
    if tag in KEEPERS:
        return False
    role = held.get("role", "").lower()
    if role in ASIDE_ROLES:
        return True
    if tag == "header" and not in_article:
        return True
    names = f"{held.get('class', '')} {held.get('id', '')}"
    words = {w.lower() for w in TOKENS.findall(names)} if names != " " else ()
    if not words or not MAIN_WORDS.isdisjoint(words) and not words & {"comment", "comments"}:
        return False
    return not ASIDE_WORDS.isdisjoint(words) or (not in_article and not HEADER_WORDS.isdisjoint(words))


def parse(page: str) -> Node:
    """The tree below a root node; elements left open end with their parent."""
    root = Node("", "", None, False)
    stack: list[tuple[str, Node, bool]] = [("", root, True)]  # tag, nearest node, whether it is a node of its own
    at, n, articles = 0, len(page), 0

    def close(k: int) -> None:
        nonlocal articles
        articles -= sum(1 for tag, _, own in stack[k:] if own and tag in ("article", "main"))
        del stack[k:]

    def close_implied(closes: frozenset[str], stops: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closes:
                return close(k)
            if stack[k][0] in stops:
                return None

    while at < n:
        found = TOKEN.search(page, at)
        if found is None or found.start() > at:
            stack[-1][1].parts.append(unescape(page[at : found.start() if found else n]))
        if found is None:
            break
        at = found.end()
        ends, tag, raw = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            inline = tag not in BLOCKS
            for k in range(len(stack) - 1, 0, -1):
                name, _, own = stack[k]
                if name == tag and (not inline or own):
                    close(k)
                    break
                if name == tag and inline:
                    if all(x[0] not in BLOCKS for x in stack[k:]):
                        close(k)
                    break
            continue
        if tag in BREAKS:
            stack[-1][1].parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = n if end is None else end.start()
                stack.append((tag, stack[-1][1], False))
            continue
        block = tag in BLOCKS
        if tag in IMPLIED:
            close_implied(*IMPLIED[tag])
        if block:
            close_implied(*PARAGRAPH)
        held = attributes(raw) if raw.strip(" /\n\t\r") else {}
        apart = set_apart(tag, held, articles > 0)
        parent = stack[-1][1]
        if block or apart:
            names = ".".join(sorted(f"{held.get('class', '')} {held.get('id', '')}".split()))
            node = Node(tag, f"{tag}.{names}" if names else tag, parent, apart)
            parent.parts.append(node)
            stack.append((tag, node, True))
            articles += tag in ("article", "main")
        else:
            stack.append((tag, parent, False))
    return root


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below ``node`` in page order, without what is set apart."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append(text)
            buffer.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            buffer.append(x)
        elif x.aside:
            if x.tag in BLOCKS:
                flush()
        elif x.tag in BLOCKS or not x.tag:
            flush()
            todo.append(None)
            todo.extend(reversed(x.parts))
        else:
            todo.extend(reversed(x.parts))
    flush()
    return out
