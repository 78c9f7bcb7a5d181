"""Markup to leaf blocks: runs of text between block-level tags, each with its path of open elements.

One pass without recursion, in time proportional to the page; malformed markup is closed the way
browsers do it (a new paragraph ends an open one, an end tag ends what is open inside, a stray one is
ignored, elements nest ``DEEPEST`` deep at most). Scripts and styles are left out, and so are pictures,
lists of choices and fields that are closed; none of them parts the block that they stand in.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
CHOICES = re.compile(r"(?:[^<]++|</?(?:option|optgroup|hr)\b[^<>]*+>)*+</select\s*+>", re.I)
#: Fixed values of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark noscript object q s samp select small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: to the end of the page if they are not closed, or only if they are.
ALWAYS_RAW, RAW_IF_CLOSED = frozenset(["script", "style"]), frozenset("iframe math svg template textarea".split())
CLOSES = {
    "li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "body": ("head",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: An open element that a start tag cannot close through.
WALLS = frozenset("table td th ul ol div section article body html form".split())
#: Fixed value: how deep browsers nest elements; those below are siblings.
DEEPEST = 512


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # one entry an open element: its tag, class, id and role words
    linked: float  # share of characters inside links


class _Finder:
    """Places of strings ahead in a page; what is found, or is not there any more, is not searched for again."""

    def __init__(self, page: str):
        self.page, self.lower, self.last = page, None, {}

    def next(self, what: str, at: int) -> int:
        found = self.last.get(what, at - 1)
        if found >= at or found == len(self.page):
            return found
        found = self.page.find(what, at)
        self.last[what] = found if found >= 0 else len(self.page)
        return self.last[what]

    def end_tag(self, tag: str, at: int) -> int:
        """Where the end tag of ``tag`` begins; the page's length if there is none."""
        if self.lower is None:
            lower = self.page.lower()
            if len(lower) != len(self.page):  # a letter became two; only ASCII letters fold then, so that places stay the same
                lower = self.page.translate({k: k + 32 for k in range(65, 91)})
            self.lower = _Finder(lower)
        return self.lower.next(f"</{tag}", at)

    def tag_end(self, at: int) -> int:
        """Where the > of the tag around ``at`` stands, outside of quoted values; the page's length if there is none."""
        while True:
            m = SPECIAL.search(self.page, at)
            if m is None:
                return len(self.page)
            if m[0] == ">":
                return m.start()
            closed = self.next(m[0], m.end()) if self.page[at : m.start()].rstrip().endswith("=") else len(self.page)
            at = closed + 1 if closed < len(self.page) else m.end()


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page, white space squeezed, references decoded; blank ones left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    open_: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []
    find = _Finder(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(t for t, _ in held)).split())
            if text:
                sizes = [(len(t.strip()), a) for t, a in held]
                total = sum(n for n, _ in sizes)
                out.append(Block(text, tuple(said for tag, said in stack if tag not in INLINE), sum(n for n, a in sizes if a) / max(1, total)))
            held.clear()

    def close(k: int) -> None:
        open_.subtract(tag for tag, _ in stack[k:])
        del stack[k:]

    at = 0
    while at < len(page):
        if page[at] != "<":
            upto = find.next("<", at)
            held.append((page[at:upto], open_["a"] > 0))
            at = upto
            continue
        if page.startswith("<!--", at):
            at = find.next("-->", at + 2) + 3
            continue
        m = TAG.match(page, at)
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = find.next(">", at) + 1
            else:
                held.append(("<", open_["a"] > 0))
                at += 1
            continue
        end, tag = m[1], m[2].lower()
        stop = find.tag_end(m.end())
        attributes, at = page[m.end() : stop], stop + 1
        if tag == "br":
            held.append((" ", False))
            continue
        if not end and (tag in ALWAYS_RAW or tag in RAW_IF_CLOSED):
            closed = find.end_tag(tag, at)
            if closed < len(page) or tag in ALWAYS_RAW:
                at = find.tag_end(closed) + 1
            continue  # one that is not closed is as if it were not there
        if not end and tag == "select" and (choices := CHOICES.match(page, at)):
            at = choices.end()
            continue
        if tag not in INLINE:
            flush()
        if end:
            if open_[tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        closes = CLOSES.get(tag, ())
        if any(open_[t] > 0 for t in closes):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    close(k)
                    break
                if stack[k][0] in WALLS:
                    break
        if tag not in VOID:
            if len(stack) >= DEEPEST:
                close(DEEPEST - 1)
            words = [w for a in ATTRIBUTE.finditer(attributes) for w in PARTS.findall((a[2] or a[3] or a[4] or "").lower())]
            stack.append((tag, " ".join([tag, *dict.fromkeys(words)])))
            open_[tag] += 1
    flush()
    return out
