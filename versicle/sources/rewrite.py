"""Documents with a span around every sentence.

Spans are put into the source text, at the places where the reader met each character; nothing else of a document changes,
not even how it is written.
"""

import html
import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Sequence
from itertools import accumulate
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import BLOCKS, Node, Tree, all_text, runs, walk


class Run(str):
    """Text that stands at `at` in the source and takes `width` characters there."""

    at: int
    width: int

    def place(self, k: int) -> int | None:
        """Where the k-th character begins; None inside a reference that stands for several."""
        return self.at + k if self.width == len(self) else {0: self.at, len(self): self.at + self.width}.get(k)


class PlacedTree(Tree):
    def __init__(self, source: str):
        self.source = source
        self.line_starts = [0, *accumulate(len(line) + 1 for line in source.split("\n"))]
        super().__init__(source, convert_charrefs=False)

    def _put(self, text: str, width: int) -> None:
        line, column = self.getpos()
        run = Run(text)
        run.at, run.width = self.line_starts[line - 1] + column, width
        self.at.children.append(run)

    def handle_data(self, data):
        self._put(data, len(data))

    def handle_entityref(self, name):
        line, column = self.getpos()
        end = self.line_starts[line - 1] + column + 1 + len(name)
        written = f"&{name};" if self.source.startswith(";", end) else f"&{name}"
        self._put(html.unescape(written), len(written))

    def handle_charref(self, name):
        self.handle_entityref(f"#{name}")


class Fault(ValueError):
    pass


def _pieces(block: Node, start: int, stop: int, at: list[int], parts: list[Run]) -> list[tuple[int, int]]:
    """(from, to) in the source of the parts of [start, stop); neighbours in the source are one piece."""
    out: list[tuple[int, int]] = []
    for i in range(bisect_right(at, start) - 1, len(parts)):
        if at[i] >= stop:
            break
        a, b = parts[i].place(max(start - at[i], 0)), parts[i].place(min(stop - at[i], len(parts[i])))
        if a is None or b is None:
            raise Fault("a bound lies inside a character reference")
        if a == b:
            continue
        if out and out[-1][1] == a:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def with_spans(source: str, entries: Iterable[tuple[str, str, int, int]], continued: str | None = None, prefix: str = "mo_s_", allow_taken: bool = False) -> str:
    """source with spans for entries (block path, element id, start, stop), offsets in the block's own text. The first
    piece of an entry bears its id, further ones the class `continued`, if there is one.

    A Fault where a path names no block, bounds lie outside it or overlap, an id is taken (or starts with prefix), the
    visible text changes, or an id does not come out exactly once.
    """
    tree = PlacedTree(source)
    plain = all_text(Tree(source).root)
    if all_text(tree.root) != plain:
        raise Fault("the text cannot be placed in its source")
    nodes = {n.path: n for n in walk(tree.root)}
    taken = {n.attrs["id"] for n in nodes.values() if n.attrs.get("id")}
    by_block: dict[str, list] = {}
    for path, element_id, start, stop in entries:
        by_block.setdefault(path, []).append((start, stop, element_id))
    wanted = [e[2] for es in by_block.values() for e in es]
    if not allow_taken and (bad := sorted(i for i in taken if i in set(wanted) or i.startswith(prefix))):
        raise Fault(f"id {bad[0]} is taken")
    marks: list[tuple[int, int, str]] = []
    for path, es in by_block.items():
        if path not in nodes:
            raise Fault(f"no element at {path}")
        parts = list(runs(nodes[path], BLOCKS))
        at = [0, *accumulate(map(len, parts))]
        size, last = at.pop(), 0
        for start, stop, element_id in sorted(es):
            if not 0 <= start <= stop <= size:
                raise Fault(f"{element_id}: bounds {start} to {stop} in a text of {size}")
            if start < last:
                raise Fault(f"{element_id}: overlaps the entry before it")
            last = stop
            rest = f" class={quoteattr(continued)}" if continued else ""
            for i, (a, b) in enumerate(_pieces(nodes[path], start, stop, at, parts)):
                marks += [(a, 1, f"<span{rest if i else f' id={quoteattr(element_id)}'}>"), (b, 0, "</span>")]
    out, upto = [], 0
    for place, _, mark in sorted(marks, key=lambda m: m[:2]):
        out += [source[upto:place], mark]
        upto = place
    new = "".join(out) + source[upto:]
    made = Tree(new).root
    if all_text(made) != plain:
        raise Fault("the visible text would change")
    ids = Counter(n.attrs.get("id") for n in walk(made))
    if bad := [i for i in wanted if ids[i] != 1]:
        raise Fault(f"id {bad[0]} stands {ids[bad[0]]} times")
    return new


def rewrite(documents: DataFrame, timeline: DataFrame, keys: Sequence[str], markup: str = "markup", continued: str | None = None) -> DataFrame:
    """(keys, markup, fault): documents with spans for timeline (keys, block_xpath, element_id, char_start, char_end). A
    document that cannot be rewritten comes back as it was with the reason in fault; one without entries, as it was.
    Entries are gathered by document."""
    entry = F.struct(F.col("block_xpath"), F.col("element_id"), F.col("char_start"), F.col("char_end"))
    gathered = timeline.groupBy(*keys).agg(F.to_json(F.collect_list(entry)).alias("_entries"))
    rows = documents.select(*keys, F.col(markup).alias("_markup")).join(gathered, list(keys), "left")
    kinds = dict(rows.dtypes)

    def one(source, entries):
        if source is None or entries is None:
            return source, None
        try:
            return with_spans(source, ([e.get(k) for k in ("block_xpath", "element_id", "char_start", "char_end")] for e in json.loads(entries)), continued), None
        except Fault as e:
            return source, str(e)

    def run(frames):
        for f in frames:
            made = [one(*r) for r in zip(f["_markup"], f["_entries"])]
            yield f[list(keys)].assign(**{markup: [m for m, _ in made], "fault": [x for _, x in made]})

    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{markup}` string", "fault string"]))
