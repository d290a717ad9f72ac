"""Lists the elements of one HTML page; runs inside the parser pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of HTML that the parser pass holds as Python objects at once; a longer page is still taken whole.
PIECE = 1 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KEPT = frozenset(
    "a nav header footer main aside section article form input select textarea label img h1 h2 h3 h4".split()
)
# Only these hand on their text; the others are kept for their place and attributes.
_TEXTED = frozenset("a main section article h1 h2 h3 h4".split())
_BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main nav ol p pre section table tbody td th thead tr ul".split()
)
_SILENT = frozenset("head script style noscript template".split())


def _is_root(tag: str, attrs: dict) -> bool:
    return (
        tag in ("main", "article")
        or attrs.get("role") == "main"
        or attrs.get("id") in ("content", "main")
        or "content" in attrs.get("class", "").split()
    )


class _Elements(HTMLParser):
    """Elements of interest in document order, each with its kept ancestors and its text.

    In ``text`` a line break stands for a block edge; line breaks of the source become blanks.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        # Open elements: (tag, index of the kept node or None, whether it collects text).
        self.stack: list[tuple[str, int | None, bool]] = []
        self.kept: list[int] = []
        self.sinks: list[list[str]] = []
        self.parts: dict[int, list[str]] = {}
        self.silent = 0
        self.rooted = False
        self._open("body", self._keep("body", {}, True), True)

    def _keep(self, tag: str, attrs: dict, texted: bool) -> int:
        idx = len(self.nodes)
        self.nodes.append({"idx": idx, "tag": tag, "attrs": attrs, "up": list(self.kept)})
        if texted:
            self.parts[idx] = []
        return idx

    def _open(self, tag: str, idx: int | None, texted: bool) -> None:
        self.stack.append((tag, idx, texted))
        self.silent += tag in _SILENT
        if idx is not None:
            self.kept.append(idx)
        if texted:
            self.sinks.append(self.parts[idx])

    def _close(self) -> str:
        tag, idx, texted = self.stack.pop()
        self.silent -= tag in _SILENT
        if idx is not None:
            self.kept.pop()
        if texted:
            self.sinks.pop()
        return tag

    def _say(self, text: str) -> None:
        for sink in self.sinks:
            sink.append(text)

    def handle_starttag(self, tag: str, pairs: list) -> None:
        attrs = {name: value or "" for name, value in reversed(pairs)}
        if tag == "body":
            self.nodes[0]["attrs"] = attrs
            return
        if tag in _BLOCKS:
            self._say("\n")
        if tag == "a":
            self.handle_endtag("a")
        root = _is_root(tag, attrs)
        self.rooted |= root
        texted = (root or tag in _TEXTED) and tag not in _VOID
        kept = tag in _KEPT or root or attrs.get("role") == "navigation"
        idx = self._keep(tag, attrs, texted) if kept else None
        if tag not in _VOID:
            self._open(tag, idx, texted)

    def handle_endtag(self, tag: str) -> None:
        if tag == "body" or all(entry[0] != tag for entry in self.stack):
            return
        while self._close() != tag:
            pass
        if tag in _BLOCKS:
            self._say("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self._say(data.replace("\n", " "))

    def listing(self) -> list[dict]:
        if self.rooted:
            # The body's text only counts on pages without a content root.
            self.parts[0] = []
        return [
            {**node, "attrs": list(node["attrs"].items()), "text": "".join(self.parts.get(node["idx"], ()))}
            for node in self.nodes
        ]


def of_page(html: str | None) -> list[dict]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    return parser.listing()


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of ``html``, so that memory does not depend on the batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = ends[low] - sizes[low]
            high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(low, high - low)
            low = high
