"""Evaluation texts leaking into training text: pigeonhole edit matching.

Texts are compared as runs of letters and digits after NFKC and case folding. An item's run of ``threshold`` characters
with at most ``max_errors`` edits must hold one of its aligned pieces of (threshold + 1) // (max_errors + 2) characters
unedited: the run covers at least max_errors + 1 whole pieces, and each edit spoils one. Pieces are found with an
Aho-Corasick automaton. From each hit Myers' bit-parallel recurrence, anchored at the piece, gives how far the item goes
on to either side for each number of edits; the item leaks if both ways and the piece make up the threshold within the
budget. A column costs a few operations on whole words, and a side ends once its band is beyond the budget.

Items are the query set: they are sent to the workers in blocks of at most BLOCK_CHARS characters (an item that is longer
is a block of its own), filled one after another. Every document is read once, whole, and matched against all blocks where
it lies; only found pairs are shuffled, to give each once. No pair is capped or dropped.

Defined results: null or empty texts match nothing; an item shorter than its threshold can't leak; repeated documents
are reported under each id, repeated rows of one id once; repeated item ids are matched as separate texts and reported
once; ids that are null are left out.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Characters that a leaked run has at least, by the item's language (fixed values of the contract).
RUN, SHORT_RUN, SHORT_LANGS = 80, 30, ("zh",)
#: Item characters that are sent to the workers at once.
BLOCK_CHARS = 8_000_000
#: Automata that a worker keeps.
KEPT_BLOCKS = 4
_NOT_KEPT = regex.compile(r"[^\p{L}\p{N}]+")
_NOT_KEPT_ASCII = regex.compile(r"[^0-9a-z]+")


def letters_and_digits(text: str | None) -> str:
    """The letters and digits of a text after NFKC and case folding."""
    if not text:
        return ""
    if text.isascii():
        return _NOT_KEPT_ASCII.sub("", text.lower())
    return _NOT_KEPT.sub("", unicodedata.normalize("NFKC", text).casefold())


def myers_distance(pattern: str, text: str) -> int:
    """The least edit distance of the pattern to any substring of the text (Myers' bit-parallel recurrence)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | ~((eq | down) | plus) & full, plus & (eq | down)
        best = min(best, score)
    return best


def char_masks(pattern: str) -> dict[str, int]:
    """The places of each character as bits."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def reach(length: int, masks: dict[str, int], text: str, errors: int) -> list[int]:
    """For 0 to ``errors`` edits the longest beginning of the pattern that a beginning of the text matches.

    Myers' recurrence with a fixed start; of each column only the band that may be within the edits is read.
    """
    full = (1 << length + 2 * errors + 1) - 1
    up, down, diagonal = full, 0, 0
    out = [min(e, length) for e in range(errors + 1)]
    for j, c in enumerate(text[: length + errors]):
        eq = masks.get(c, 0)
        bit = 1 << j
        diagonal += bool(up & bit) - bool(down & bit)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, up & zero
        diagonal += bool(plus & bit) - bool(minus & bit)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | ~(zero | plus) & full, plus & zero
        least = diagonal
        if diagonal <= errors and j + 1 <= length:
            out[diagonal] = max(out[diagonal], j + 1)
        here = diagonal
        for i in range(j + 1, j + 1 + errors):  # rows below the diagonal
            here += bool(up >> i & 1) - bool(down >> i & 1)
            least = min(least, here)
            if here <= errors and i < length:
                out[here] = max(out[here], i + 1)
        here = diagonal
        for i in range(j, max(-1, j - errors), -1):  # rows above it
            here -= bool(up >> i & 1) - bool(down >> i & 1)
            least = min(least, here)
            if here <= errors and i <= length:
                out[here] = max(out[here], i)
        if least > errors:
            break
    for e in range(1, errors + 1):
        out[e] = max(out[e], out[e - 1])
    return out


class LeakMatcher:
    """Finds which of the given items leak into a text; items are (id, normalised text, threshold)."""

    def __init__(self, items: list[tuple[int, str, int]], max_errors: int = 0) -> None:
        self.items, self.k = items, max_errors
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, threshold) in enumerate(items):
            size = (threshold + 1) // (max_errors + 2)
            if size < 1:
                raise ValueError("max_errors is too large for the threshold")
            if len(text) >= threshold:
                for at in range(0, len(text) - size + 1, size):
                    places.setdefault(text[at : at + size], []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.sides: dict[tuple[int, int], tuple[int, dict[str, int], int, dict[str, int]]] = {}

    def leaked(self, text: str | None) -> list[int]:
        """The ids of the items of which the text holds a run of their threshold within max_errors edits, in order."""
        return self.leaked_body(letters_and_digits(text))

    def leaked_body(self, body: str) -> list[int]:
        """``leaked`` of a text that is normalised already."""
        found: set[int] = set()
        if not len(self.automaton) or not body:
            return []
        for end, (size, where) in self.automaton.iter(body):
            for n, at in where:
                if n not in found and self._verified(n, at, size, body, end - size + 1):
                    found.add(n)
        return sorted({self.items[n][0] for n in found})

    def _verified(self, n: int, at: int, size: int, body: str, start: int) -> bool:
        _, text, threshold = self.items[n]
        side = self.sides.get((n, at))
        if side is None:  # what of the item lies before and behind the piece, within the threshold
            before, behind = text[max(0, at + size - threshold) : at][::-1], text[at + size : at + threshold]
            side = self.sides[n, at] = len(before), char_masks(before), len(behind), char_masks(behind)
        m, masks, m2, masks2 = side
        k, end = self.k, start + size
        right = reach(m2, masks2, body[end : end + m2 + k], k)
        if right[k] + size + m < threshold:
            return False
        left = reach(m, masks, body[max(0, start - m - k) : start][::-1], k)
        return any(left[e] + size + right[k - e] >= threshold for e in range(k + 1))


_MATCHERS: OrderedDict[tuple[str, int], LeakMatcher] = OrderedDict()


def _matcher(block: tuple[str, Broadcast], max_errors: int) -> LeakMatcher:
    """The matcher of a broadcast block, built once per worker while it is among the last used."""
    name, value = block
    key = (name, max_errors)
    if key not in _MATCHERS:
        _MATCHERS[key] = LeakMatcher(value.value, max_errors)
        if len(_MATCHERS) > KEPT_BLOCKS:
            _MATCHERS.popitem(last=False)
    _MATCHERS.move_to_end(key)
    return _MATCHERS[key]


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str, int]]]:
    """Normalised items (id, text, threshold) in blocks of at most BLOCK_CHARS characters, read partition by partition."""
    block: list[tuple[int, str, int]] = []
    chars = 0
    rows = items.select("item_id", "lang", "item_text").filter("item_id is not null and item_text is not null").dropDuplicates()
    for r in rows.toLocalIterator():
        text = letters_and_digits(r.item_text)
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r.item_id, text, SHORT_RUN if r.lang in SHORT_LANGS else RUN))
        chars += len(text)
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, max_errors: int = 0) -> DataFrame:
    """(item_id, doc_id): the items that leak, and the documents they leak into."""
    sc = documents.sparkSession.sparkContext
    shipped = [(uuid.uuid4().hex, sc.broadcast(block)) for block in item_blocks(items)]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies = [letters_and_digits(t) for t in b["text"]]
            hits = [(i, d) for block in shipped for m in [_matcher(block, max_errors)] for d, t in zip(b["doc_id"], bodies, strict=True) for i in m.leaked_body(t)]
            yield pd.DataFrame(hits, columns=["item_id", "doc_id"])

    bodies = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return bodies.mapInPandas(match, "item_id long, doc_id long").dropDuplicates()
