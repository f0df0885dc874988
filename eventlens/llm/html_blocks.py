"""Leaf blocks of web pages, with what the block labeller sees of each."""

from __future__ import annotations

import html
import math
import re
from typing import NamedTuple
from zlib import crc32

import numpy as np

#: Elements that end a block (fixed names of the language); all others are part of the running text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul video".split()
)
#: Elements whose content is no text of the page.
SILENT_TAGS = frozenset("script style noscript template textarea title noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element ends if it is open, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
}
_NEAR = 64  # open elements that such an end is looked for in, and tags of a page whose quotes may lack their end

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/>])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECE = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

PATH, WORDS, SHAPE = 512, 256, 8
WIDTH = PATH + WORDS + SHAPE


class Block(NamedTuple):
    text: str
    path: int  # a bit for each hashed tag, class, id and role of the open elements
    leaf: str
    linked: int  # code points inside links
    depth: int


def _bit(token: str) -> int:
    return 1 << (crc32(token.encode()) % PATH)


def _mark(tag: str, attributes: str) -> int:
    out = _bit(tag)
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and _HIDDEN.search(value):
            out |= _bit("!hidden")
        elif name in ("class", "id", "role"):
            for piece in _PIECE.findall(value.lower()):
                out |= _bit(f".{piece}")
    return out


def blocks(page: str) -> list[Block]:
    """The texts between block elements of a page in order, empty ones left out.

    Character references are decoded and white space becomes one space; a line break inside a block is white space.
    Comments, declarations and silent elements are left out, unfinished ones to the end of the page. End tags that may be
    left out are supplied; those without an opening tag are ignored. A sign "<" that begins no tag is text. In one page
    the quotes of at most 64 tags may lack their end; then a tag ends at its first ">".
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    held: list[str] = []
    linked, in_link, unclosed = 0, 0, 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                leaf = next((t for t, _ in reversed(stack[-_NEAR:]) if t in BLOCK_TAGS), "")
                out.append(Block(text, stack[-1][1] if stack else 0, leaf, min(linked, len(text)), len(stack)))
            held.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            tag, _ = stack.pop()
            open_tags[tag] -= 1
            in_link -= tag == "a"

    def say(piece: str) -> None:
        nonlocal linked
        held.append(piece)
        if in_link:
            linked += len(piece)

    while at < size:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        if i > at:
            say(page[at:i])
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), i) or page.startswith("</", i) and not page[i + 2 : i + 3].isalpha():
            end = page.find(">", i)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, i)
        if name is None:
            say("<")
            at = i + 1
            continue
        end = page.find(">", name.end())
        if end < 0:
            break
        if unclosed < _NEAR:
            quoted = _QUOTED.match(page, name.end())
            if quoted:
                end = quoted.end() - 1
            else:
                unclosed += 1
        tag, attributes, closing = name[1].lower(), page[name.end() : end], page[i + 1] == "/"
        at = end + 1
        if tag in SILENT_TAGS:
            if not closing:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if found is None:
                    break
                end = page.find(">", found.end())
                at = size if end < 0 else end + 1
            continue
        if tag == "br":
            say(" ")
            continue
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
        if closing:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                pop_to(depth)
            continue
        if is_block and open_tags.get("p"):
            depth = len(stack) - 1
            while stack[depth][0] != "p":
                depth -= 1
            pop_to(depth)
        if tag in ENDS:
            ends, beyond = ENDS[tag]
            depth = len(stack)
            for j in range(len(stack) - 1, max(-1, len(stack) - 1 - _NEAR), -1):
                if stack[j][0] in beyond:
                    break
                if stack[j][0] in ends:
                    depth = j
            pop_to(depth)
        if tag in VOID_TAGS or attributes.endswith("/") and not is_block:
            continue
        above = stack[-1][1] if stack else 0
        stack.append((tag, above | _mark(tag, attributes) if is_block or attributes.strip() else above))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        in_link += tag == "a"
    flush()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """float32 [blocks, WIDTH]: bits of the path, hashed words of unit length, and the shape of the text."""
    n = len(found)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    path = np.frombuffer(b"".join(b.path.to_bytes(PATH // 8, "little") for b in found), np.uint8).reshape(n, -1)
    out[:, :PATH] = np.unpackbits(path, axis=1, bitorder="little")
    row, column, value = [], [], []
    for i, b in enumerate(found):
        words = _WORD.findall(b.text.lower())
        cells = {crc32(w.encode()) % WORDS for w in set(words)}
        row += [i] * len(cells)
        column += cells
        value += [1 / math.sqrt(max(1, len(cells)))] * len(cells)
        size = len(b.text)
        signs = sum(map(b.text.count, ".,;:!?"))
        out[i, PATH + WORDS :] = math.log1p(size) / 6, math.log1p(len(words)) / 5, b.linked / size, signs / (len(words) + 1), b.text[-1] in ".!?…:\"”", "©" in b.text, b.leaf[:1] == "h" and b.leaf[1:].isdigit(), min(b.depth, 20) / 20
    out[row, np.array(column, int) + PATH] = value
    return out
