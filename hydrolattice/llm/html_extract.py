"""Main text of web pages as the maximum-scoring run of words and tags.

Words score by the element that holds them and tags score negative; the weights come from labelled pages, which are those
with one element that marks its content (``article`` or ``main``). One linear scan finds the best contiguous region.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, remainder, slices, stored

SAMPLE_PAGES = 20_000
LEAST_SEEN = 3  # words or tags under a key in the sample; rarer keys take the score of their element

# Element names of the HTML standard and names that sites give to parts beside the content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title object canvas select".split())
ASIDE = frozenset("nav aside footer header form menu dialog button".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer disqus footer header menu modal nav navbar navigation newsletter notice pagination popup promo promoted related "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

# Words beside a side word that leave its meaning as it is.
FILL_WORDS = frozenset("area bar block body bottom box container content group holder inner item left link links list outer panel right row section slot top unit wrap wrapper".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")  # a bracket ends a name, so that names of tags left open are not read again and again
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")  # looks no further than the next bracket
_STOPS = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z]+")


class Token:
    """A piece of text (``name`` empty) or a tag, with the innermost element key and whether it lies inside a side part."""

    __slots__ = ("name", "key", "text", "holder", "aside", "in_content", "opens")

    def __init__(self, name: str, key: str, text: str, holder: str, aside: bool, in_content: bool, opens: bool):
        self.name, self.key, self.text, self.holder, self.aside, self.in_content, self.opens = name, key, text, holder, aside, in_content, opens


class Tags:
    """The tags and comments of a page from left to right, in time that grows with its length whatever it holds.

    A tag ends at the first ``>`` outside of quotes. Where no such end exists, ``<`` is text; places from which a search has
    failed are kept, so that none is walked twice.
    """

    def __init__(self, page: str):
        self.page, self.dead, self.failed, self.unclosed = page, len(page) + 1, set(), {}
        self.since = self.stop = -1  # no bracket or quote lies between these places

    def end_of(self, at: int) -> int:
        """The place behind the tag whose attributes start at ``at``, or -1."""
        walked: list[int] = []
        while at < self.dead:
            if walked or not self.since <= at <= self.stop:
                stop = _STOPS.search(self.page, at)
                if stop is None:
                    self.dead = at
                    break
                i = stop.start()
                if not walked:
                    self.since, self.stop = at, i
            else:
                i = self.stop
            if self.page[i] == ">":
                return i + 1
            if i in self.failed:
                break
            walked.append(i)
            close = self.page.find(self.page[i], i + 1)
            if close < 0:
                break
            at = close + 1
        self.failed.update(walked)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; a comment or declaration has no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if plain := _PLAIN.match(page, start):
                return start, plain.end(), plain[1], plain[2].lower(), plain[3]
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, len(page) if close < 0 else close + 3, "", "", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                if start + 1 < self.dead and (close := page.find(">", start)) >= 0:
                    return start, close + 1, "", "", ""
                self.dead = min(self.dead, start + 1)
            elif (name := _NAME.match(page, start + 1)) and (end := self.end_of(name.end())) >= 0:
                return start, end, name[1], name[2].lower(), page[name.end() : end - 1]
            at = start + 1
        return None

    def behind(self, name: str, at: int) -> int:
        """The place behind the next end tag of an element with raw content, or -1."""
        if at >= self.unclosed.get(name, len(self.page) + 1):
            return -1
        close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
        if close is None:
            self.unclosed[name] = at
            return -1
        return close.end()


def side_words(attributes: str) -> tuple[list[str], set[str]]:
    """All words of class, id and role, and the side words among them: a name counts where its other words only fill in."""
    every: list[str] = []
    side: set[str] = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in _PARTS.split(name) if w]
            every += words
            if all(w in ASIDE_WORDS or w in FILL_WORDS for w in words):
                side |= ASIDE_WORDS.intersection(words)
    return every, side


class Part:
    """An element that its class, id or role (or being a form) makes a side part, with the words it holds in the whole page and in content."""

    __slots__ = ("words", "nested", "plain", "content")

    def __init__(self, words: frozenset[str], nested: frozenset[str]):
        self.words, self.nested, self.plain, self.content = words, nested, 0, 0


def tokens(page: str) -> list[Token]:
    """Texts and tags in page order. Comments, scripts, styles and other raw content are left out."""
    parts: list[Part] = []
    found, plain, content = _scan(page, frozenset(), parts)
    wrappers = _wrappers(parts, plain, content) if parts else frozenset()
    return _scan(page, wrappers, [])[0] if wrappers else found


def _wrappers(parts: list[Part], plain: int, content: int) -> frozenset[int]:
    """Numbers of the parts that are no side parts, because alone, or together with others of the same word, they hold more
    than half of the words in ``article`` and ``main``, or of the page where these hold none."""
    whole, held = (content, [p.content for p in parts]) if content else (plain, [p.plain for p in parts])
    alone = {i for i, n in enumerate(held) if 2 * n > whole}
    sums = Counter()
    for i, p in enumerate(parts):
        if i not in alone:
            for w in p.words - p.nested:
                sums[w] += held[i]
    usual = {w for w, n in sums.items() if 2 * n > whole}
    return frozenset(alone | {i for i, p in enumerate(parts) if p.words <= usual})


def _scan(page: str, wrappers: frozenset[int], parts: list[Part]) -> tuple[list[Token], int, int]:
    """Tokens of a page, its words outside of side elements, and its words in ``article`` and ``main``. Inside these two
    nothing counts as side part for what lies around them."""
    out: list[Token] = []
    stack: list[tuple[str, str, tuple]] = []  # name, key, state before it
    names: Counter = Counter()  # of the stack
    open_parts: list[Part] = []  # parts that hold the present place; their counts are differences of the page's
    at = aside = named = content = words_plain = words_content = number = 0
    inside_words: frozenset[str] = frozenset()
    tags = Tags(page)

    def text(piece: str) -> None:
        nonlocal words_plain, words_content
        out.append(Token("", "", piece, stack[-1][1] if stack else "", aside > 0, content > 0, False))
        if not named:
            n = len(piece.split())
            words_plain += n
            words_content += n if content else 0

    def close(depth: int) -> None:
        nonlocal aside, named, content, inside_words
        aside, named, content, inside_words, held = stack[depth][2]
        for name, _, _ in stack[depth:]:
            names[name] -= 1
        del stack[depth:]
        while len(open_parts) > held:
            part = open_parts.pop()
            part.plain, part.content = words_plain - part.plain, words_content - part.content

    while at < len(page):
        tag = tags.next(at)
        if tag is None:
            text(page[at:])
            break
        start, end, slash, name, attributes = tag
        if start > at:
            text(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            key = f"/{name}"
            if names[name] > 0:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                key = f"/{stack[depth][1]}"
                close(depth)
            out.append(Token(name, key, "", "", aside > 0, content > 0, False))
            continue
        if name in RAW:
            behind = tags.behind(name, at)
            at = behind if behind >= 0 else (len(page) if name in ("script", "style", "textarea", "title") else at)
            out.append(Token(name, name, "", "", aside > 0, content > 0, True))
            continue
        found, side = side_words(attributes) if attributes else ([], set())
        key = ".".join([name, *sorted(set(found))[:3]])
        if name in VOID:
            out.append(Token(name, key, "", "", aside > 0, content > 0, True))
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and names[name] > 0:  # elements that end an open one of their kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        out.append(Token(name, key, "", "", aside > 0, content > 0, True))
        stack.append((name, key, (aside, named, content, inside_words, len(open_parts))))
        names[name] += 1
        if name in ("article", "main"):
            aside = named = 0
            content += 1
        elif name in ASIDE and name != "form":
            is_side = not (name == "header" and content)
            aside += is_side
            named += is_side
        if name not in ("html", "body", "article", "main") and (name not in ASIDE or name == "form"):
            words = side | ({"form"} if name == "form" else set())
            if words:
                part = Part(frozenset(words), inside_words)
                part.plain, part.content = words_plain, words_content
                inside_words |= part.words
                parts.append(part)
                open_parts.append(part)
                aside += number not in wrappers
                number += 1
    for part in open_parts:
        part.plain, part.content = words_plain - part.plain, words_content - part.content
    return out, words_plain, words_content


def observe(page: str, counts: Counter, longest: Counter) -> None:
    """Add a labelled page: tags and words by key, inside and outside of its content. Other pages add nothing."""
    found = tokens(page)
    if sum(t.opens and t.name in ("article", "main") for t in found) != 1:
        return
    run = 0
    for t in found:
        inside = t.in_content and not t.aside
        if t.name:
            border = t.name in ("article", "main")
            if not t.aside:  # tags inside a side part say nothing about its surroundings
                counts[("t", t.key, inside and not border)] += 1
        else:
            n = len(t.text.split())
            counts[("w", t.holder, inside)] += n
            run = 0 if inside else run + n
            longest["outside"] = max(longest["outside"], run)


class Weights:
    """Score of a tag key and of a word under an element key. Unseen keys take the score of their element name, then a default."""

    def __init__(self, rows: list[tuple[str, str, int, int]], outside: int):
        self.run = float(max(outside, 50))
        self.tag: dict[str, float] = {}
        self.word: dict[str, float] = {}
        for kind, key, inside, out in rows:
            share = (inside + 0.5) / (inside + out + 1)
            if kind == "t":
                self.tag[key] = -0.05 - self.run * (1 - share) ** 2
            else:
                self.word[key] = max(-5.0, min(5.0, math.log(share / (1 - share))))

    def of_tag(self, key: str) -> float:
        score = self.tag.get(key)
        return score if score is not None else self.tag.get(key.split(".")[0], -1.0)

    def of_word(self, holder: str, aside: bool) -> float:
        if aside:
            return -2.0
        score = self.word.get(holder)
        return score if score is not None else max(0.5, self.word.get(holder.split(".")[0], 1.0))


def best_region(scores: list[float]) -> tuple[int, int]:
    """First maximum-scoring contiguous run as (start, end); empty where no score is positive."""
    best, start, end, total, since = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, since = 0.0, i
        total += score
        if total > best:
            best, start, end = total, since, i + 1
    return start, end


def extract(page: str, weights: Weights) -> str:
    """Blocks of the best region without side parts, white space as one space, joined by empty lines."""
    found = tokens(page)
    scores = [weights.of_tag(t.key) if t.name else weights.of_word(t.holder, t.aside) * len(t.text.split()) for t in found]
    start, end = best_region(scores)
    blocks: list[list[str]] = [[]]
    for t in found[start:end]:
        if not t.name:
            if not t.aside:
                blocks[-1].append(t.text)
        elif t.name in BLOCKS:
            blocks.append([])
        elif t.name == "br":
            blocks[-1].append(" ")
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n\n".join(b for b in joined if b)


def learn(pages: DataFrame, *, page: str = "html", key: str = "page_id", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most about ``sample`` pages that may be labelled, chosen by hash of their key.

    Counts are summed inside each task first. Without labelled pages every word scores 1 and every tag -1.
    """
    marked = pages.where(F.col(page).rlike(r"(?i)<(?:article|main)[\s/>]")).select(F.col(page).alias("page"), F.col(key).alias("key"))
    modulus = max(1, -(-marked.count() // sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, longest = Counter(), Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    observe(text, counts, longest)
        rows = [(*k, n) for k, n in counts.items()] + [("longest", "", False, n) for n in longest.values()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "key", "inside", "n"])

    partial = stored(marked.where(remainder("key", modulus) == 0).select("page").mapInArrow(run, "kind string, key string, inside boolean, n bigint"), "page_counts")
    outside = partial.where("kind = 'longest'").agg(F.max("n")).first()[0] or 0
    inside = F.col("inside")
    table = partial.where("kind <> 'longest'").groupBy("kind", "key").agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("b"),
    )
    rows = table.where(F.col("a") + F.col("b") >= LEAST_SEEN).collect()  # of a bounded sample of pages
    return Weights([(r["kind"], r["key"], r["a"], r["b"]) for r in rows], 2 * outside)


def main_text(pages: DataFrame, keep: list[str], weights: Weights, *, page: str = "html") -> DataFrame:
    """``keep`` columns with ``text`` (empty where nothing scores) and ``n_chars`` (its code points).

    Missing and empty pages give an empty text; repeated rows stay.
    """
    rows = ([("t", k, v) for k, v in weights.tag.items()] + [("w", k, v) for k, v in weights.word.items()], weights.run)

    def build():
        own = Weights([], 0)
        own.run = rows[1]
        for kind, key, score in rows[0]:
            (own.tag if kind == "t" else own.word)[key] = score

        def compute(texts: list[str]):
            out = [extract(t, own) for t in texts]
            return out, [len(t) for t in out]

        return compute

    return map_texts(pages, page, keep, "text string, n_chars bigint", build)
