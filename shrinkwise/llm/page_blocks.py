"""HTML pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser
from typing import NamedTuple

# Elements that start and end blocks of text, elements without content, elements whose text is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea"
    " tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template noscript svg math object canvas audio video iframe".split())
# What an opening tag closes if it is still open, and the elements it does not look beyond.
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
SCOPES = frozenset("ul ol dl table select div section article main aside nav header footer form body html".split())
CLOSES_P = BLOCK_TAGS - {"option", "body", "head", "html", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}

_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s")


class Path:
    """Tags around a block, as the innermost one and the path outside of it: equal paths of a tree are one object.

    `fresh` are the tokens (tag, class and id names) that no outer tag has. `vector` is for whoever reads paths.
    """

    __slots__ = ("outer", "tokens", "fresh", "inner", "vector")

    def __init__(self, outer: Path | None, tokens: tuple[str, ...], fresh: tuple[str, ...]):
        self.outer, self.tokens, self.fresh = outer, tokens, fresh
        self.inner: dict[tuple[str, ...], Path] = {}
        self.vector = None

    def tags(self) -> list[tuple[str, ...]]:
        """Tokens of every tag, from the outside in."""
        found, at = [], self
        while at.outer is not None:
            found.append(at.tokens)
            at = at.outer
        return found[::-1]


class PathTree:
    """Paths met so far, from an empty one on."""

    def __init__(self) -> None:
        self.root, self.size = Path(None, (), ()), 0

    def within(self, outer: Path, tokens: tuple[str, ...], open_tokens: dict[str, int]) -> Path:
        """The path one tag further in; `open_tokens` tells which tokens its outer path has."""
        if (found := outer.inner.get(tokens)) is None:
            fresh = tuple({t: None for t in tokens if not open_tokens.get(t)})
            found = outer.inner[tokens] = Path(outer, tokens, fresh)
            self.size += 1
        return found

    def path(self, tags: Iterable[tuple[str, ...]]) -> Path:
        """The path of some tags from the outside in."""
        at, seen = self.root, {}
        for tokens in tags:
            at = self.within(at, tokens, seen)
            seen.update(dict.fromkeys(tokens, 1))
        return at


class Block(NamedTuple):
    """Text without needless white space, the tags around it, letters in links."""

    text: str
    path: Path
    linked: int


class _Reader(HTMLParser):
    """Collects blocks. Places of open tags are kept by name, so what a tag closes is known without a search."""

    def __init__(self, tree: PathTree) -> None:
        super().__init__(convert_charrefs=True)
        self.tree, self.blocks = tree, []
        self.open: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.tokens: dict[str, int] = {}
        self.held: list[str] = []
        self.linked = self.links = self.silent = 0

    def path(self) -> Path:
        return self.open[-1][1] if self.open else self.tree.root

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append(Block(text, self.path(), self.linked))
            self.held, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in CLOSES_P:
                self._close(("p",))
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag])
        elif tag == "br":
            self.held.append(" ")
        if tag in VOID_TAGS:
            return
        tokens = (tag,)
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                tokens += tuple([f".{n}" for n in _NAME.findall(v.lower())])
        path = self.tree.within(self.path(), tokens, self.tokens)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((tag, path))
        for t in tokens:
            self.tokens[t] = self.tokens.get(t, 0) + 1
        self.links += tag == "a"
        self.silent += tag in SILENT_TAGS

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)
            if self.links:
                self.linked += len(_SPACE.sub("", data))

    def _close(self, tags: tuple[str, ...]) -> None:
        """Closes the innermost of the tags within the nearest scope, and what is open in it."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if at >= 0 and (not self.scopes or at > self.scopes[-1]):
            self._pop_to(at)

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            tag, path = self.open.pop()
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            for t in path.tokens:
                self.tokens[t] -= 1
            self.links -= tag == "a"
            self.silent -= tag in SILENT_TAGS


def page_blocks(html: str | None, tree: PathTree | None = None) -> list[Block]:
    """Blocks of a page in order. Character references are decoded; markup that is never closed ends with the page.

    Pages that are read with one `tree` share their paths.
    """
    reader = _Reader(tree or PathTree())
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks
