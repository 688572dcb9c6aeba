"""Sentence units across languages and scripts: a linear-chain tagger decoded with Viterbi.

Every character is tagged as boundary (a unit ends behind it) or inside. Only characters that can end a unit - terminal
marks with the closers behind them, and blanks in a script that writes sentences without marks - have a free tag; all
others are inside, which leaves a short lattice per block of text. Blank lines and list markers fix tags beforehand.

The model scores a tag by features of the place (mark, word before, word behind, gap, state of quotes and brackets, and in
the unpunctuated script the letters on either side) and a pair of neighbouring tags by how near they are. It is an
averaged structured perceptron with a margin, fitted once per process on the labelled paragraphs of ``labelled``; no
document and no rule takes part in the fit or in a decision. For the unpunctuated script (Thai) punctuated sentences are
stripped of their punctuation, their boundaries kept as labels. Words that begin sentences are counted over all whole
documents (``corpus_starters``) and only tell classes of words apart.

Documents are tagged where they lie, whole and without a shuffle. Offsets count code points.

Defined results: null, empty and blank texts have no unit; a unit never begins or ends with white space; a list item with
its marker is one unit, up to the first line break that the model takes for the end of a sentence; unbalanced quotes and
brackets are ignored; repeated documents are cut alike under each id; an id that is null has no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.engine.shared import durable
from tallyspark.llm import labelled

#: Passes over the labelled paragraphs, and the margin that training asks for.
PASSES, MARGIN = 8, 1.0
#: Times that a word must begin a certain sentence to count as a starter, and its share of all such beginnings: both at least.
STARTER_COUNT, STARTER_SHARE = 2, 1e-4
#: Characters on either side of a blank that the model looks at in the script without marks.
LEFT, RIGHT = 1, 3
#: Distinct tokens whose class a worker remembers.
REMEMBERED = 200_000
#: How far before a mark, and behind it, a token is looked for.
TOKEN_BEFORE, TOKEN_BEHIND = 40, 60

# Abbreviations, in lower case without the last point. The first never end a sentence before a capital or
# digit; the second may.
TITLES_AND_REFERENCES = frozenset(
    "mr mrs ms dr prof st no nr nos kap abs art cf vgl fig figs pp sec rev e.g i.e vs v fri mon tue wed thu sat sun approx ca bzw ggf z.b d.h u.a "
    "núm sr sra srta aprox incl c.-à-d m mme mlle p.ej p.ex ex ej al ph ed vol डॉ د".split()
)
OPEN_ENDED = frozenset("u.s u.k e.u p.m a.m etc usw inc corp ltd co min max ph.d".split())
#: Of the latter, those that a sentence beginning with a number may follow.
BEFORE_NUMBER = frozenset("u.s u.k e.u p.m a.m etc usw".split())
#: Words that name a zone behind a time of day.
ZONES = frozenset("eastern central pacific mountain atlantic gmt utc cet cest est edt cst pst ist jst".split())
#: German words before the day or rank in "am 3. Mai".
BEFORE_RANK = frozenset("am vom im zum dem den der des bis seit ab beim und".split())

PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "《": "》", "‹": "›"}
BRACKETS = "([（【"
_ENDS = frozenset(PAIRS.values())
_PAIR_MARKS = regex.compile("[" + regex.escape("".join({*PAIRS, *PAIRS.values(), '"', "`"})) + "]")
CLOSERS = ")]）】」』»”“\"’›"
OPENERS = "([（【「『«“„‘\"¿¡‹'《〈"
CJK_MARKS, DANDA = "。！？｡︕︖", "।॥։።។။"
# a point between a token's characters, such as in numbers and file names, ends nothing
_TERMINAL = regex.compile(rf"(?!(?<![.!?…])\.[\da-z])(?:[.!?…؟‽۔{CJK_MARKS}{DANDA}．]+)(?:[   ]?[{regex.escape(CLOSERS)}]|[*_]{{1,3}}(?=\s|$))*")
_MARKS = regex.compile(rf"[^\s*_{regex.escape(CLOSERS)}]+")
_THAI_LETTER = regex.compile(r"\p{Thai}")
_BLANK_LINE = regex.compile(r"(?:\r\n|\r|\n| )[^\S\r\n]*(?:(?:\r\n|\r|\n| )[^\S\r\n]*)+| ")
_LINE = regex.compile(r"\r\n|\r|\n| ")
_MARKER = regex.compile(r"[^\S\r\n]*(?:(?P<b>[-*•–·▪‣●○◦])[^\S\r\n]+|(?P<n>\d{1,3})[.)、）][^\S\r\n]*(?![\d])|(?P<p>[(（]\d{1,2}[)）])[^\S\r\n]*|(?P<l>[a-z])\)[^\S\r\n]+)(?=\S)")
_WORD = regex.compile(r"[\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}]](?:[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}]]|[\u200b\u200c\u200d\u00ad](?=\p{L})|['’](?=\p{L}))*", regex.V1)
_INVISIBLE = regex.compile("[\u200b\u200c\u200d\u2060\u00ad\ufeff]")
_IDENT = regex.compile(r"[a-z][a-z0-9]*_[a-z0-9_]+")
_THAI = regex.compile(r"(?<=\p{Thai})\s+(?=\S)|(?<=\S)\s+(?=\p{Thai})")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_GLUED = regex.compile(r"(?<=[\p{Ll}\d%)])[.!?]+[\"”»’)]*([\p{Lu}][\p{L}\p{N}_.]*)$")


@dataclass(slots=True)
class Place:
    """A character that may end a unit: the offset behind it, and its features."""

    end: int
    kind: str
    before: str
    after: str
    gap: str
    quote: str
    left: str = ""
    right: str = ""

    def classes(self) -> tuple[str, str, str, str, str]:
        return self.kind, self.before, self.after, self.gap, self.quote

    def features(self) -> tuple[str, ...]:
        k, b, a, g, q = self.classes()
        own = (
            f"{k}|{b}|{a}|{g}|{q}", f"{k}|{b}|{a}|{q}", f"{k}|{a}|{q}", f"{k}|{b}|{a}", f"{k}|{a}|{g}", f"{b}|{a}", f"{q}|{a}", f"{k}|{q}", f"k{k}", f"b{b}", f"a{a}", f"g{g}", f"q{q}",
        )
        return (*own, f"l{self.left}", f"r{self.right}", f"r2{self.right[:2]}") if self.left or self.right else own


@dataclass
class Block:
    """A stretch between fixed boundaries: its span in the text, whether it is a list item, and its places."""

    start: int
    end: int
    item: bool
    places: list[Place] = field(default_factory=list)


def _paired(text: str) -> list[tuple[int, int, str]]:
    """(open, close, opener) of the outermost balanced quotes and brackets."""
    out, stack, straight = [], [], None
    last = {}
    for m in _PAIR_MARKS.finditer(text):
        k, c = m.start(), m[0]
        if c in "\"`":
            if straight and straight[1] == c:
                out.append((straight[0], k, c))
                straight = None
            elif straight is None and text.find(c, k + 1) >= 0:
                straight = (k, c)
        elif stack and c == PAIRS[stack[-1][1]]:
            o, opener = stack.pop()
            out.append((o, k, opener))
        elif c in PAIRS and last.setdefault(c, text.rfind(PAIRS[c])) > k:
            stack.append((k, c))
        elif c in _ENDS:  # close an opener further out, if there is one
            for d in range(len(stack) - 1, -1, -1):
                if PAIRS[stack[d][1]] == c:
                    out.append((stack[d][0], k, stack[d][1]))
                    del stack[d:]
                    break
    out.sort()
    outer: list[tuple[int, int, str]] = []
    for p in out:
        if not outer or p[0] > outer[-1][1]:
            outer.append(p)
    return outer


def _unglued(token: str) -> str:
    """The last word of a token in which the blank behind a sentence is missing."""
    m = _GLUED.search(token)
    return m[1] if m and m.start() >= 2 else token


@lru_cache(maxsize=REMEMBERED)
def _token_class(token: str, previous: str) -> str:
    """The class of a token before a mark; previous is the token before it where that matters."""
    token = _unglued(_INVISIBLE.sub("", token)).strip("*_`").lstrip("([（【「『«“„‘\"'¿¡-–")
    if len(token) > 2 and token[1] in "'’" and token[0].isalpha():  # an elided article
        token = token[2:]
    low = token.casefold()
    if not token:
        return "none"
    if low in TITLES_AND_REFERENCES:
        return "title"
    if low in OPEN_ENDED:
        return "open:number" if low in BEFORE_NUMBER else "open"
    if len(token) == 1 and token.isalpha() and not _CJK.match(token):
        return "initial" if token.isupper() else "letter"
    if token.isdigit() and len(token) <= 2:
        return "rank" if _unglued(previous).casefold() in BEFORE_RANK else "digits"
    if token[-1].isdigit() or token[-1] in "%‰":
        return "number"
    if "_" in token or "/" in token or "@" in token:
        return "ident"
    return "word"


def _word_before(text: str, at: int) -> str:
    """The class of what stands before a mark."""
    left = text[max(0, at - TOKEN_BEFORE) : at]
    if not left or left[-1].isspace():
        return "none"
    two = left.rsplit(None, 2)
    return _token_class(two[-1], two[-2] if left[-1].isdigit() and len(two) > 1 else "")


@lru_cache(maxsize=REMEMBERED)
def _head_class(head: str, glued: bool, pointed: bool, starters: frozenset[str]) -> str | None:
    """The class of the token that follows a mark; None if all of it opens something. pointed: the mark ends in a point."""
    k, end = 0, len(head)
    while k < end and head[k] in "\u200b\u200c\u200d\u00ad\ufeff":
        k += 1
    while k < end and head[k] in OPENERS + "`*_" and not (head[k] == "'" and k + 1 < end and not head[k + 1].isalnum()):
        k += 1
    if k >= end:
        return None
    c = head[k]
    if c.isdigit():
        return "digit"
    if _IDENT.match(head, k):
        return "ident" if not glued or not pointed else "lower"
    if m := _WORD.match(head, k):
        word = _INVISIBLE.sub("", m[0]).casefold()
        if c.isupper() and head[m.end() : m.end() + 1].isdigit():
            return "code"
        if word in ZONES:
            return "zone"
        if c.isupper():
            return "starter" if word in starters else "single" if len(m[0]) == 1 else "upper" if not glued or m[0][1:2].islower() else "caps"
        if c.islower():
            return "low starter" if not glued and "~" + word in starters else "lower"
        return "nocase"
    return "cjk" if _CJK.match(c) else "punct"


def _next(text: str, at: int, end: int, starters: frozenset[str]) -> tuple[str, str]:
    """The class of what stands behind a mark, and the gap between."""
    near = text[at : min(end, at + TOKEN_BEHIND)]
    rest = near.lstrip()
    if not rest and at + TOKEN_BEHIND < end:  # a long gap
        near = text[at:end]
        rest = near.lstrip()
    gap = "none" if len(rest) == len(near) else "line" if _LINE.search(near, 0, len(near) - len(rest)) else "space"
    if not rest:
        return "end", gap
    head = rest.split(None, 1)[0]
    found = _head_class(head, gap == "none", text[at - 1] == ".", starters)
    if found is None:  # an opener that a blank follows
        k = at + len(near) - len(rest) + len(head)
        blank = text[k : min(end, k + TOKEN_BEHIND)]
        token = blank.lstrip(" \u00a0\u2009\u202f")
        if token[:1].isspace() or not token:
            return "punct", gap
        found = _head_class(token.split(None, 1)[0], gap == "none", text[at - 1] == ".", starters) or "punct"
    return found, gap


@lru_cache(maxsize=REMEMBERED)
def _mark(text: str) -> str:
    if any(c in CJK_MARKS for c in text):
        return "cjk"
    if any(c in DANDA for c in text):
        return "danda"
    if any(c in "!?؟‽" for c in text):
        return "ask"
    if "……" in text:
        return "cjk dots"
    return "dots" if "…" in text or ".." in text else "point"


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Spans between blank lines and list markers, and whether each is a list item."""
    at = 0
    spans = []
    for m in _BLANK_LINE.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    for start, end in spans:
        lines, k = [start], start
        for m in _LINE.finditer(text, start, end):
            lines.append(m.end())
        begin, item, number = start, False, None
        for n, k in enumerate(lines):
            m = _MARKER.match(text, k, end)
            if not m:
                continue
            this = int(m["n"]) if m["n"] else None
            before = text[begin:k].rstrip()
            ended = before[-1:] in tuple(".!?…:：;；" + CJK_MARKS + DANDA + CLOSERS + "؟")
            follows = item and (this is None or number is None or this == number + 1)
            if n == 0 or follows or (ended and (this is None or this == 1)):
                if n:
                    yield begin, k, item
                begin, item, number = k, True, this
        yield begin, end, item


def parse(text: str, starters: frozenset[str]) -> list[Block]:
    """The blocks of a text with the places of each that may end a unit."""
    out = []
    paired, thai = _PAIR_MARKS.search(text) is not None, not text.isascii() and _THAI_LETTER.search(text) is not None
    for start, end, item in _blocks(text):
        block = Block(start, end, item)
        out.append(block)
        pairs = _paired(text[start:end]) if paired else []
        p = 0
        marks = []
        for m in _TERMINAL.finditer(text, start, end):
            at, close = m.span()
            if close - at == 1:
                body = text[at]
            else:
                body = _MARKS.match(text, at, close)[0]
                stop = at + len(body)
                # closers that open the next quote don't belong to this mark
                while close > stop and text[close - 1] in "“\"" and any(start + o == close - 1 for o, _, _ in pairs):
                    close -= 1
                while close > stop and text[close - 1] in " \u00a0\u202f":
                    close -= 1
            while p < len(pairs) and start + pairs[p][1] < at:
                p += 1
            quote = "none"
            if p < len(pairs) and start + pairs[p][0] < at:
                o, c, opener = pairs[p]
                if start + c < close:
                    before = text[start : start + o].rstrip()
                    fresh = not before or before[-1] in ".!?…؟" + CJK_MARKS + DANDA or (before[-1] in CLOSERS and before[-2:-1] in tuple(".!?…؟" + CJK_MARKS + DANDA))
                    kind = "bracket" if opener in BRACKETS else "quote"
                    quote = f"{kind} at start" if fresh else f"{kind} led" if before[-1] in ":：,，" else f"{kind} within"
                else:
                    quote = "inside"
            after, gap = _next(text, close, end, starters)
            marks.append(Place(close, _mark(body), _word_before(text, at), after, gap, quote))
        if not thai:
            block.places = marks
            continue
        blanks, marked = [], {q.end for q in marks}
        for m in _THAI.finditer(text, start, end):
            a, b = text[m.start() - 1], text[m.end()]
            if m.start() in marked:
                continue
            kinds = ["thai" if _THAI_LETTER.match(c) else "latin" if c.isalnum() else "other" for c in (a, b)]
            held = any(start + o < m.start() < start + c for o, c, _ in pairs)
            blanks.append(Place(m.start(), "blank", kinds[0], kinds[1], "line" if _LINE.search(m[0]) else "space", "inside" if held else "none", text[max(start, m.start() - LEFT) : m.start()], text[m.end() : m.end() + RIGHT]))
        block.places = sorted(marks + blanks, key=lambda q: q.end)
    return out


#: What comes before the first word of a block, and before a word behind a certain mark (Java patterns): a word of three
#: letters or a number, its mark, a blank and opening marks.
_BLOCK_BEGINS = r"(?:^|(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n))\s*[\p{Ps}\p{Pi}\p{Po}]*"
_MARK_BEGINS = r"[.!?](?<=(?:\p{Ll}{3}|[0-9%])[.!?])\s+[\p{Ps}\p{Pi}¿¡\"]*"
_OPENING = r"([\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]][\p{L}\p{M}'’]*+)(?![\p{N}])"


def opening_words(documents: DataFrame) -> DataFrame:
    """(word, n): how often each word begins a certain sentence, counted over all whole texts.

    Words that begin blocks in lower case, such as names of columns, are marked with ~.
    """
    text = F.col("text")
    first = F.regexp_extract_all(text, F.lit(_BLOCK_BEGINS + _OPENING), F.lit(1))
    behind = F.regexp_extract_all(text, F.lit(_MARK_BEGINS + _OPENING.replace(r"([\p{L}", r"([\p{Lu}", 1)), F.lit(1))
    upper = lambda w: w.rlike(r"^\p{Lu}")
    named = F.transform(first, lambda w: F.when(upper(w), F.lower(w)).when(w.rlike(r"^\p{Ll}"), F.concat(F.lit("~"), F.lower(w))))
    words = F.concat(named, F.transform(behind, lambda w: F.lower(w)))
    return documents.select(F.explode(words).alias("word")).filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corpus_starters(documents: DataFrame) -> frozenset[str]:
    """Opening words of all documents (see ``STARTER_SHARE``); at most 1 / ``STARTER_SHARE`` words reach the driver."""
    counts = durable(opening_words(documents.select("text").filter("text <> ''")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.word for r in counts.filter(F.col("n") >= max(STARTER_COUNT, STARTER_SHARE * total)).collect())


@dataclass
class Model:
    """Feature weights of the boundary tag, weights of neighbouring tags, and the words that begin sentences."""

    weights: dict[str, float]
    pairs: dict[tuple[bool, bool, str], float]
    starters: frozenset[str]
    scores: dict[tuple[str, ...], float] = field(default_factory=dict, repr=False, compare=False)

    def score(self, q: Place) -> float:
        """The boundary tag's score; places of the same features share it."""
        key = (q.kind, q.before, q.after, q.gap, q.quote, q.left, q.right)
        found = self.scores.get(key)
        if found is None:
            if len(self.scores) >= REMEMBERED:
                self.scores.clear()
            found = self.scores[key] = sum(self.weights.get(f, 0.0) for f in q.features())
        return found

    def decode(self, places: list[Place], gold: list[bool] | None = None) -> list[bool]:
        """The best tags of a block's places (Viterbi); in training, wrong tags are favoured by the margin."""
        if not places:
            return []
        if len(places) == 1 and gold is None:
            return [self.score(places[0]) > 0]
        pair = self.pairs.get
        yes = no = 0.0
        back: list[tuple[bool, bool]] = []
        previous = None
        for k, q in enumerate(places):
            score = self.score(q)
            up, down = score, -score
            if gold is not None:
                up, down = (up, down + MARGIN) if gold[k] else (up + MARGIN, down)
            if previous is None:
                yes, no = up, down
            else:
                near = _distance(previous, q)
                a, b = no + pair((False, True, near), 0.0), yes + pair((True, True, near), 0.0)
                c, d = no + pair((False, False, near), 0.0), yes + pair((True, False, near), 0.0)
                back.append((d > c, b > a))
                yes, no = max(a, b) + up, max(c, d) + down
            previous = q
        tag = yes > no
        out = [tag]
        for row in reversed(back):
            tag = row[tag]
            out.append(tag)
        return out[::-1]


def _distance(a: Place | None, b: Place) -> str:
    return "" if a is None else "near" if b.end - a.end <= 4 else "far"


def labelled_places(text: str, ends: list[int], starters: frozenset[str]) -> list[tuple[list[Place], list[bool]]]:
    """The places of each block with their tags."""
    at = set(ends)
    return [(b.places, [q.end in at for q in b.places]) for b in parse(text, starters) if b.places]


def fit(paragraphs: list[tuple[str, list[int]]], starters: frozenset[str]) -> Model:
    """An averaged structured perceptron on paragraphs (text, offsets behind their sentences)."""
    blocks = [b for text, ends in paragraphs for b in labelled_places(text, ends, starters)]
    weights: dict[str, float] = defaultdict(float)
    pairs: dict[tuple[bool, bool, str], float] = defaultdict(float)
    sums: dict = defaultdict(float)
    model, step = Model(weights, pairs, starters), 1
    for _ in range(PASSES):
        wrong = 0
        for places, gold in blocks:
            guess = model.decode(places, gold)
            if guess != gold:
                wrong += 1
                model.scores.clear()
                for k, q in enumerate(places):
                    if guess[k] != gold[k]:
                        sign = 1.0 if gold[k] else -1.0
                        for f in q.features():
                            weights[f] += sign
                            sums[f] += sign * step
                    if k:
                        near = _distance(places[k - 1], q)
                        for tags, sign in ((gold, 1.0), (guess, -1.0)):
                            key = (tags[k - 1], tags[k], near)
                            pairs[key] += sign
                            sums[key] += sign * step
            step += 1
        if not wrong:
            break
    mean = lambda d: {k: v - sums[k] / step for k, v in d.items() if v - sums[k] / step}
    return Model(mean(weights), mean(pairs), starters)


@lru_cache(maxsize=1)
def trained_model() -> Model:
    """The model of the labelled paragraphs, fitted once per process; it knows the words that begin their sentences."""
    return fit([(text, ends) for text, ends, _ in labelled.paragraphs()], labelled.openings())


def model_for(documents: DataFrame) -> Model:
    """The trained model with the words that begin sentences in all documents beside its own."""
    trained = trained_model()
    return Model(trained.weights, trained.pairs, trained.starters | corpus_starters(documents))


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every unit of the text."""
    if not text:
        return []
    out = []
    for block in parse(text, model.starters):
        places = block.places
        ends = [q.end for q, tag in zip(places, model.decode(places), strict=True) if tag]
        if block.item and ends:  # an item goes on to the first boundary that a line break follows
            broken = [q.end for q in places if q.gap == "line" and q.after != "end"]
            rest = next((e for e in ends if e in broken), block.end)
            ends = [e for e in ends if e >= rest]
        start = block.start
        for end in [*ends, block.end]:
            part = text[start:end]
            body = part.lstrip()
            if body:
                a = start + len(part) - len(body)
                out.append((a, a + len(body.rstrip())))
            start = end
    return out


def sentence_units(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence, heading or list item of every document."""
    model = model or model_for(documents)

    def cut(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                own = units(t, model)
                ids += [d] * len(own)
                starts += [a for a, _ in own]
                ends += [e for _, e in own]
            yield pd.DataFrame({"doc_id": ids, "start_char": starts, "end_char": ends}, dtype="int64")

    bodies = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return bodies.mapInPandas(cut, "doc_id long, start_char long, end_char long")
