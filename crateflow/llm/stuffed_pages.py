"""Keyword-stuffed and link-list pages.

A text is read as a sequence of terms (content words; links apart). Recurrence decides: for each term the
gap since it last stood and the gap before that, and the autocorrelation of the sequence in a sliding
window at every lag up to ``LAGS``. Terms in unnaturally regular repetition, links that recur without
prose between them, and lists of distinct nouns without function words are the three signs of a page
made for machines. Obfuscated words (``ch3ap``, ``c.h.e.a.p``) are read as the words they stand for, and
``<a href>`` and ``[text](link)`` markup as a link beside its text.

A parliament repeats itself too: formulas, votes, lists of its own business. The corpus tells them from
foreign ones. For every word, the documents are counted in which it stands in prose that doesn't repeat,
in lists with words of the corpus' headings, and in repetition or other lists. Words mostly of the last
kind are *foreign*; regular repetition and lists only count where foreign words make them, or where
hardly a function word stands in a long repetition at a lag of one or two.

A page is reported when more than half of its characters (white space left out) stand in such segments.

The sets of heading words and foreign words are broadcast up to ``MOST_WORDS`` hashes (16 MB); beyond that
they are joined to the words of each document, with the same result.

Defined cases: null, empty or blank texts are never reported; repeated rows are reported once; texts of
any length, a few words or millions, are judged whole by the same rule; ties at exactly half aren't
reported. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.session import durable

#: Lags looked at for recurrence and autocorrelation, and terms in a window.
LAGS, WINDOW = 24, 10
#: Share of a window's terms that repeat from which its repetition is regular.
REGULAR = 0.35
#: Below this share of function words a segment is a list; with fewer foreign words it isn't a foreign one.
FUNCTION_SHARE, FOREIGN_SHARE = 0.15, 0.3
#: Links without prose between them that make a list of links.
LINK_RUN = 3
#: A word is the corpus' own if it stands in prose and own lists of so many documents for each of other kinds.
OWN = 0.75
MOST_WORDS = 1 << 21
#: Frequent function words of English, French, Spanish and German.
FUNCTION_WORDS = frozenset(
    """
the of to and a an in on for that is was are has have had with by at from this which who not be it as i we you he she they our their your his its if but or so will would should could must may
cannot do does did than there these those been before after about into without under over between against all no nor very well
le la les l un une des du de d et en à au aux pour par sur dans ne pas que qui se ce cette ces son sa ses notre nos leur il elle je nous vous est sont ont été contre avec sans mes ma mon mais ou où y
el los las una unos unas del al e con sobre contra su sus es son ha han lo como más pero o este esta estos desde nuestro nuestra mi
der die das den dem ein eine einen einem einer oder im am auf für mit von vom zu zum zur bei nach seit über unter gegen ohne nicht ist sind war hat haben wir ihr ich sie er es dass wie als auch
nur noch um aus vor dieser diese dieses wer was sich
""".split()
)

_LINK = re.compile(r"(?:https?://|www\.)\S|(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*)?$", re.I)
_MARKUP = re.compile(r"(?<=[\"'>])(?=[^\s\"'<>])|(?<=[^\s])(?=<)|(?<=\])(?=\()")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_DOTTED = re.compile(r"(?:[^\W\d_]\.){3,}[^\W\d_]?")
_LEET = str.maketrans("013457", "oieast")
_EDGE = "()[]<>{}\"'«»“”,;|*"


def words(token: str) -> list[str]:
    """Lower-cased words of a piece of text without links; obfuscated spellings undone, numbers left out."""
    if "." in token:
        token = _DOTTED.sub(lambda m: m[0].replace(".", "") + " ", token)
    if not token.isascii():
        token = unicodedata.normalize("NFC", token)
    out = []
    for w in _WORD.findall(token.lower()):
        if not w.isalpha():
            if any(c.isdigit() for c in w):
                if not any(c.isalpha() for c in w):
                    continue
                w = w.translate(_LEET)
            if "'" in w or "’" in w:
                out.extend(re.split("['’]", w))
                continue
        out.append(w)
    return out


def hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def is_link(token: str) -> bool:
    if "." not in token:
        return False
    bare = token.removeprefix("href=").strip(_EDGE)
    return bool(_LINK.match(bare)) and not _DOTTED.fullmatch(bare) and (bare.count(".") > 0 and not bare.endswith("."))


class Tokens(dict):
    """What each white-space token holds: a number per token, and tables by that number."""

    MOST = 400_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.term: dict[str, int] = {}
        self.hash: list[int] = []
        self.terms: list[list[int]] = []
        #: Per token: characters, words, function words, content terms, whether a link, whether a sentence ends.
        self.table = np.zeros((6, 1 << 12), np.int64)

    def __missing__(self, token: str) -> int:
        link = is_link(token)
        found = [] if link or token.startswith(("<", "href=")) else words(token)
        # l and d are articles only before an apostrophe; an obfuscated word is no function word
        plain = len(found) > 1 or not (found and found[0] in ("l", "d")) and not any(map(str.isdigit, token))
        content = [w for w in found if not plain or w not in FUNCTION_WORDS]
        for w in content:
            if w not in self.term:
                self.term[w] = len(self.hash)
                self.hash.append(hashed(w))
        out = self[token] = len(self.terms)
        self.terms.append([self.term[w] for w in content])
        tail = token.rstrip(")]\"'»”")
        initial = len(tail) == 2 and bool(found)
        end = not link and tail[-1:] in tuple(".!?:;") and not initial or token[:4].lower() in ("<br>", "</li", "</p>")
        if out == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, out] = len(token), len(found), len(found) - len(content), len(content), link, end
        return out


class Page:
    """A text's tokens, cut into segments: each link is one, else the sentences of a line, short ones together."""

    def __init__(self, text: str, tokens: Tokens) -> None:
        if "<" in text or "](" in text:
            text = _MARKUP.sub(" ", text)
        at: list[int] = []
        breaks: list[int] = []
        for line in text.split("\n"):
            at += [tokens[t] for t in line.split()]
            breaks.append(len(at))
        self.tokens, self.at = tokens, np.array(at, np.int64)
        size, n, function, many, link, end = tokens.table[:, self.at]
        m = len(at)
        cut = np.zeros(m + 1, bool)
        cut[breaks] = True
        hard = cut.copy()
        link = link.astype(bool)
        hard[:-1][link] = True
        hard[1:][link] = True
        cut |= hard
        cut[1:] |= end.astype(bool)
        cut[0] = hard[0] = True
        if m:
            self._merge(cut, hard, n)
        self.start = np.flatnonzero(cut[:m])
        total = (lambda x: np.add.reduceat(x, self.start)) if m else (lambda x: np.zeros(0, np.int64))
        self.size, self.n, self.function = total(size), total(n), total(function)
        self.link = link[self.start] if m else np.zeros(0, bool)
        self.line = np.searchsorted(np.array(breaks), self.start, side="right")
        self.segment = np.cumsum(cut[:m]) - 1
        self.place = np.repeat(np.arange(m), many)
        self.key = np.fromiter(chain.from_iterable(map(tokens.terms.__getitem__, at)), np.int64, len(self.place))

    @staticmethod
    def _merge(cut: np.ndarray, hard: np.ndarray, n: np.ndarray, least: int = 6) -> None:
        """Take back soft cuts that leave fewer than ``least`` words."""
        upto = np.concatenate([[0], np.cumsum(n)])
        places = np.flatnonzero(cut)
        last = int(places[0])
        kept = [last]
        for p in places[1:].tolist():
            if hard[p]:
                if upto[p] - upto[last] < least and not hard[last] and len(kept) > 1:
                    cut[last] = False  # a short rest belongs to what stands before it on the line
                    kept.pop()
                last = p
                kept.append(p)
            elif upto[p] - upto[last] < least:
                cut[p] = False
            else:
                last = p
                kept.append(p)

    def regular(self, lags: int = LAGS) -> np.ndarray:
        """Which content terms stand in regular repetition with gaps of at most ``lags``."""
        x, m = self.key, len(self.key)
        out = np.zeros(m, bool)
        if m < 4:
            return out
        order = np.argsort(x, kind="stable")
        same = x[order][1:] == x[order][:-1]
        gap = np.full(m, 1 << 30)
        gap[order[1:][same]] = np.diff(order)[same]
        recurs = gap <= lags
        width = min(WINDOW, m)
        least = max(3, ceil(REGULAR * width))

        def dense(hit: np.ndarray) -> np.ndarray:
            """Places in a window with enough hits."""
            run = np.concatenate([[0], np.cumsum(hit)])
            full = np.concatenate([[0], np.cumsum(run[width:] - run[:-width] >= least)])
            at = np.arange(m)
            return full[np.minimum(at + 1, len(full) - 1)] > full[np.maximum(at - width + 1, 0)]

        around = dense(recurs)
        if not around.any():
            return out
        # recurrence gaps: a term whose gap is about its last one
        before = np.full(m, 1 << 30)
        before[order[1:][same]] = gap[order[:-1][same]]
        found = dense(recurs & (np.abs(gap - before) <= 2))
        # positional autocorrelation: the best lag of each window
        for lag in range(1, min(lags, m - 1) + 1):
            hit = np.zeros(m, bool)
            hit[lag:] = x[lag:] == x[:-lag]
            if np.count_nonzero(hit) >= least:
                found |= dense(hit)
        return found & self._recurring(recurs, gap)

    @staticmethod
    def _recurring(recurs: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Terms that recur, and those that they repeat."""
        out = recurs.copy()
        at = np.flatnonzero(recurs)
        out[at - gap[at]] = True
        return out

    def per_segment(self, hit: np.ndarray) -> np.ndarray:
        return np.bincount(self.segment[self.place[hit]], minlength=len(self.start))

    def link_lists(self) -> np.ndarray:
        """Segments of runs of links that no prose stands between, with their labels."""
        out = np.zeros(len(self.start), bool)
        links = np.flatnonzero(self.link)
        if len(links) < LINK_RUN:
            return out
        prose = ~self.link & ((self.n >= 7) & (self.function >= 0.2 * self.n) | (self.n > 14))
        blocks = np.concatenate([[0], np.cumsum(prose)])
        run = np.concatenate([[0], np.cumsum(blocks[links[1:]] != blocks[links[:-1]])])
        for r in np.flatnonzero(np.bincount(run) >= LINK_RUN):
            own = links[run == r]
            first, last = own[0], own[-1]
            while first and not prose[first - 1] and not self.link[first - 1] and self.line[first - 1] == self.line[first]:
                first -= 1
            while last + 1 < len(self.start) and not prose[last + 1] and not self.link[last + 1] and self.line[last + 1] == self.line[last]:
                last += 1
            out[first : last + 1] = True
        return out


def kinds(text: str, tokens: Tokens, headings: Callable[[int], bool]) -> tuple[set[int], set[int], set[int]]:
    """Content terms of a text by where they stand: prose that doesn't repeat, own lists, repetition and other lists."""
    page = Page(text, tokens)
    out: tuple[set[int], set[int], set[int]] = set(), set(), set()
    if not len(page.start):
        return out
    again = page.per_segment(page.regular(6))
    terms = np.bincount(page.segment[page.place], minlength=len(page.start))
    prose = (page.function >= 0.2 * page.n) & (again < 0.6 * terms)
    if prose.all():
        out[0].update(page.key.tolist())
        return out
    ends = np.cumsum(terms)
    for s, (a, b) in enumerate(zip((ends - terms).tolist(), ends.tolist(), strict=True)):
        found = page.key[a:b].tolist()
        if prose[s]:
            out[0].update(found)
        elif found:
            out[1 if sum(map(headings, found)) >= 0.12 * int(page.n[s]) else 2].update(found)
    return out


def stuffed_share(text: str, tokens: Tokens, foreign: Callable[[int], bool]) -> float:
    """Share of the text's characters (white space left out) that stand in stuffed segments."""
    page = Page(text, tokens)
    total = int(page.size.sum())
    if not total:
        return 0.0
    bad = page.link_lists()
    strange = np.fromiter(map(foreign, page.key.tolist()), bool, len(page.key))
    if strange.any() or len(page.key) >= LAGS:
        regular = page.regular()
        terms = np.maximum(np.bincount(page.segment[page.place], minlength=len(page.start)), 1)
        few = page.function < FUNCTION_SHARE * page.n
        u, r, both = page.per_segment(strange) / terms, page.per_segment(regular) / terms, page.per_segment(strange & regular) / terms
        # unnaturally regular repetition; lists of distinct nouns without function words
        bad |= (both >= 0.4) | ((both >= 0.2) & few) | (few & (u >= FOREIGN_SHARE))
        # repetition at a lag of one or two without function words is no language, whosever words it has
        bad |= (page.function <= 0.02 * page.n) & (terms >= LAGS) & (page.per_segment(page.regular(2)) >= 0.9 * terms) & (r > 0)
    return float(page.size[bad].sum() / total)


def _column_words(documents: DataFrame, column: str) -> DataFrame:
    """(h): hashes of the content words of a column."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for b in batches:
            fresh = set(b.column(0).to_pylist()) - known - {None}
            if len(known) < 100_000:
                known |= fresh
            found = sorted({hashed(w) for text in fresh for w in words(text) if w not in FUNCTION_WORDS})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])

    return documents.select(F.col(column).cast("string")).mapInArrow(local, "h bigint").distinct()


def _marked(documents: DataFrame, marks: DataFrame, most: int) -> tuple[DataFrame, Callable[[], np.ndarray] | None]:
    """Documents (id, t) with an array ``marks`` of the hashes among their words, or that set for a broadcast where it is small.

    Which way is taken depends on a count of the set, not on the documents; both find the same.
    """
    if marks.count() <= most:
        found = np.sort(marks.toArrow().column("h").to_numpy())
        shared = documents.sparkSession.sparkContext.broadcast(found)
        return documents.withColumn("marks", F.lit(None).cast("array<bigint>")), lambda: shared.value

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            if len(tokens) > Tokens.MOST:
                tokens.clear()
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    h = sorted({tokens.hash[x] for x in Page(t, tokens).key.tolist()})
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(h, pa.int64())], names=["u", "h"])

    keyed = durable(documents.withColumn("u", F.monotonically_increasing_id()))
    found = keyed.select("u", "t").mapInArrow(local, "u bigint, h bigint").join(marks, "h").groupBy("u").agg(F.collect_list("h").alias("marks"))
    return keyed.join(found, "u", "left").select("id", "t", F.coalesce("marks", F.array().cast("array<bigint>")).alias("marks")), None


class _Members:
    """Whether a term's hash is in a set, remembered per term."""

    def __init__(self, tokens: Tokens, shared: np.ndarray | None) -> None:
        self.tokens, self.shared, self.known = tokens, shared, {}

    def of(self, marks: list[int] | None) -> Callable[[int], bool]:
        if self.shared is None:
            inside = set(marks or ())
            return lambda term: self.tokens.hash[term] in inside
        return self._look

    def _look(self, term: int) -> bool:
        hit = self.known.get(term)
        if hit is None:
            h = self.tokens.hash[term]
            at = np.searchsorted(self.shared, h)
            hit = self.known[term] = bool(at < len(self.shared) and self.shared[at] == h)
        return hit


def foreign_words(documents: DataFrame, headings: DataFrame, names: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(h): hashes of the words that stand mostly in repetition and other lists; documents are counted, over all of (id, t)."""
    marked, shared = _marked(documents, headings, most)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        heads = _Members(tokens, shared() if shared else None)
        counts: tuple[Counter[int], ...] = (Counter(), Counter(), Counter())

        def flush() -> pa.RecordBatch:
            hit = sorted(set().union(*counts))
            out = [pa.array(np.array([tokens.hash[x] for x in hit], np.int64))] + [pa.array(np.array([c[x] for x in hit], np.int64)) for c in counts]
            for c in counts:
                c.clear()
            tokens.clear()
            heads.known.clear()
            return pa.RecordBatch.from_arrays(out, names=["h", "a", "b", "c"])

        for b in batches:
            for t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    for c, found in zip(counts, kinds(t, tokens, heads.of(marks)), strict=True):
                        c.update(found)
            if len(tokens) > Tokens.MOST:
                yield flush()
        yield flush()

    zero = F.lit(0).cast("bigint")
    counted = marked.select("t", "marks").mapInArrow(local, "h bigint, a bigint, b bigint, c bigint").withColumn("named", F.lit(False))
    own = headings.union(names).select("h", zero.alias("a"), zero.alias("b"), zero.alias("c"), F.lit(True).alias("named"))
    sums = counted.unionByName(own).groupBy("h").agg(*[F.sum(c).alias(c) for c in "abc"], F.max("named").alias("named"))
    return durable(sums.where(~F.col("named") & (F.col("a") + F.col("b") < OWN * F.col("c"))).select("h"))


def scores(documents: DataFrame, id_col: str = "doc_id", text: str = "text", heading: str = "agenda_item", name: str = "speaker", most: int = MOST_WORDS) -> DataFrame:
    """(id_col, share): how much of each document's text is stuffed; a row for each row."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"))
    headings = durable(_column_words(documents, heading))
    marked, shared = _marked(rows, foreign_words(rows, headings, _column_words(documents, name), most), most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        foreign = _Members(tokens, shared() if shared else None)
        for b in batches:
            if len(tokens) > Tokens.MOST:
                tokens.clear()
                foreign.known.clear()
            share = [stuffed_share(t, tokens, foreign.of(m)) if t else 0.0 for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share, pa.float64())], names=["id", "share"])

    kind = dict(documents.dtypes)[id_col]
    return marked.select("id", "t", "marks").mapInArrow(score, f"id {kind}, share double").withColumnRenamed("id", id_col)


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text: str = "text", heading: str = "agenda_item", name: str = "speaker", least: float = 0.5, most: int = MOST_WORDS) -> DataFrame:
    """(id_col, share): pages of which more than ``least`` is stuffed."""
    return scores(documents, id_col, text, heading, name, most).where(F.col("share") > least).dropDuplicates([id_col])
