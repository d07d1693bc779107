"""HTML as a tree of block elements with their texts, and statistics of its nodes."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash

# Elements of the HTML standard by how they are laid out.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Their content is no text of the page.
SILENT_TAGS = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video "
    "button select option datalist head".split()
)
#: A start tag ends an open element of these kinds first, unless one of the bounds lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"""
    r"""(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>)""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|data-role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """A block element, or a run of text between the block elements of one."""

    tag: str
    parent: int
    depth: int
    words: tuple[str, ...] = ()  # of class, id, role and the like
    texts: list[str] = field(default_factory=list)  # its own runs, white space made single
    linked: int = 0  # characters of them in links
    children: list[int] = field(default_factory=list)


def attribute_words(attrs: str) -> tuple[str, ...]:
    """Lower-case words of the attributes that name an element's part in the page."""
    out: list[str] = []
    for m in _ATTR.finditer(attrs):
        out += [w.lower() for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(out))


def parse(page: str) -> list[Node]:
    """Nodes in page order; the first one is the root. Any input gives a tree, broken markup too.

    Comments, scripts, styles and other elements without page text are left out. Character references are
    decoded; a run of text is what stands between two block boundaries, ``br`` counting as white space.
    """
    nodes = [Node("#root", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their block
    opened: Counter = Counter()  # of the stack, so that what is not there is not looked for
    run: list[str] = []
    linked = links = silent = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                at = stack[-1][1]
                node = Node("#run", at, nodes[at].depth + 1, texts=[text], linked=min(linked, len(text)))
                nodes[at].children.append(len(nodes))
                nodes.append(node)
            run.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            linked += len(text) if links else 0

    def pop_to(size: int) -> None:
        nonlocal links, silent
        if any(tag in BLOCK_TAGS for tag, _ in stack[size:]):
            flush()
        for tag, _ in stack[size:]:
            opened[tag] -= 1
            links -= tag == "a"
            silent -= tag in SILENT_TAGS
        del stack[size:]

    def open_at(names: frozenset[str], bounds: frozenset[str]) -> int:
        if not any(opened[n] for n in names):
            return 0
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                return at
            if stack[at][0] in bounds:
                return 0
        return 0

    at = 0
    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if not opened[tag]:
                continue
            place = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag)
            block_between = tag not in BLOCK_TAGS and any(t in BLOCK_TAGS for t, _ in stack[place + 1 :])
            if not block_between:
                pop_to(place)
            continue
        if tag in BLOCK_TAGS and (place := open_at(frozenset(["p"]), frozenset(["button", "td", "th", "object"]))):
            pop_to(place)
        if tag in BLOCK_TAGS and (place := open_at(frozenset(["head"]), frozenset())):
            pop_to(place)  # page content ends a head that was left open
        if tag in ENDS and (place := open_at(*ENDS[tag])):
            pop_to(place)
        if tag == "br":
            say(" ")
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            end = close.start() if close else len(page)
            at = page.find(">", end) + 1 if close else end
            at = at or len(page)
            continue
        if m["attrs"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS:
            flush()
            parent = stack[-1][1]
            nodes[parent].children.append(len(nodes))
            stack.append((tag, len(nodes)))
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, attribute_words(m["attrs"])))
        else:
            stack.append((tag, stack[-1][1]))
        opened[tag] += 1
        links += tag == "a"
        silent += tag in SILENT_TAGS
    say(page[at:])
    flush()
    return nodes


# Groups of tags that look alike to a reader.
_GROUPS = {
    name: i
    for i, names in enumerate(
        "#root html body|article main|nav menu|header|footer|aside|form fieldset|div center|section|p #run|"
        "h1|h2 h3 h4 h5 h6|ul ol dl dir|li dt dd|table tbody thead tfoot tr|td th caption|"
        "blockquote pre|figure figcaption|address details summary dialog".split("|")
    )
    for name in names.split()
}
N_GROUPS = max(_GROUPS.values()) + 2
N_WORDS = 96  # hashed attribute words
NUMBERS = (
    "depth chars share blocks chars_per_block links_per_char stops_per_char begin end siblings place like_siblings "
    "sibling_chars parent_chars heads paragraphs items capitals own_run parent_links"
).split()
N_FEATURES = len(NUMBERS) + 2 * N_GROUPS + 2 * N_WORDS
_STOP = re.compile(r"[.!?,;:…。、]")
_CAPITAL = re.compile(r"[A-Z]")


def _word_place(word: str) -> int:
    return xxhash.xxh32_intdigest(word, 5) % N_WORDS


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its subtree's text and density, tags and attribute words of it and of its parent,
    its depth and place, and how it compares with its siblings."""
    n = len(nodes)
    chars, links, stops, blocks, tags = (np.zeros(n) for _ in range(5))
    heads, paragraphs, items, capitals = (np.zeros(n) for _ in range(4))
    begin, end = np.zeros(n), np.zeros(n)
    at = 0
    for i, node in enumerate(nodes):
        begin[i] = at
        for text in node.texts:
            chars[i] += len(text)
            stops[i] += len(_STOP.findall(text))
            capitals[i] += len(_CAPITAL.findall(text))
            blocks[i] += 1
            at += len(text)
        end[i] = at
        links[i] = node.linked
        tags[i] = node.tag != "#run"
        heads[i] = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        paragraphs[i] = node.tag == "p"
        items[i] = node.tag in ("li", "td")
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (chars, links, stops, blocks, tags, heads, paragraphs, items, capitals):
            a[p] += a[i]
        end[p] = max(end[p], end[i])
    order = np.zeros(n)  # of a node among its siblings
    kinds = [Counter(nodes[c].tag for c in node.children) for node in nodes]
    for node in nodes:
        order[node.children] = np.arange(len(node.children))
    out = np.zeros((n, N_FEATURES), np.float32)
    total = max(chars[0], 1)
    for i, node in enumerate(nodes):
        parent = max(node.parent, 0)
        brothers = nodes[parent].children if i else [0]
        own = chars[i]
        out[i, : len(NUMBERS)] = (
            node.depth,
            np.log1p(own),
            own / total,
            np.log1p(blocks[i]),
            np.log1p(own / max(blocks[i], 1)),
            links[i] / max(own, 1),
            stops[i] / max(own, 1),
            begin[i] / total,
            end[i] / total,
            np.log1p(len(brothers)),
            order[i] / len(brothers),
            (kinds[parent][node.tag] if i else 1) / len(brothers),
            own * len(brothers) / max(chars[parent], 1),
            own / max(chars[parent], 1),
            heads[i],
            np.log1p(paragraphs[i]),
            np.log1p(items[i]),
            capitals[i] / max(own, 1),
            kinds[i]["#run"],
            links[parent] / max(chars[parent], 1),
        )
        base = len(NUMBERS)
        for who in (node, nodes[parent]):
            out[i, base + _GROUPS.get(who.tag, N_GROUPS - 1)] = 1
            for word in who.words:
                out[i, base + N_GROUPS + _word_place(word)] = 1
            base += N_GROUPS + N_WORDS
    return out
