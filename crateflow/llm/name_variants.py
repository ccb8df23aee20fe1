"""Variant spellings of names typed by people, linked to the entity they name.

Spellings that differ in format only become one node. MinHash bands over the padded q-grams of a name's
distinctive tokens (those few names share) propose pairs; the number of bands is computed from the
collision curve for a wanted recall. Monge-Elkan similarity, with typos, initials, nicknames and
abbreviations as inner similarities, verifies each pair; star clustering around the fullest and most
frequent spelling groups the nodes.

Values that name nobody are left out: garbled text, placeholders, credits of several artists, and values
made of words that the corpus uses as titles.

Defined cases: null, empty and signs-only values are left out; repeated rows only raise a spelling's
count; a name without a partner is a cluster of its own; ties go to the lower spelling by code point.
Names of any length are read whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm import garbled_text
from crateflow.session import durable, shuffle_partitions

SLOTS = 1 << 18
Q, ROWS = 2, 3
#: Pairs of this Jaccard similarity are to be found with this probability.
TUNED_AT, RECALL = 0.45, 0.97
LEAST_SCORE = 0.8
#: A word that a spelling leaves out stands in at least so many nodes.
LEFT_OUT = 8
#: Matched words tell an artist if they would meet by chance in at most this share of the nodes; an initial
#: is taken to meet a word in a tenth of them.
RARE, INITIAL = 0.004, 0.1
#: Fewer nodes say too little about shares: a word is then as rare as if it stood among so many.
FEW = 15_000

#: Words whose letters and slots a process keeps, and pairs of words whose similarity a task keeps from batch to batch.
WORDS, MET = 1 << 16, 1 << 18

#: Given names and their common short forms.
NICKNAMES = {
    "alexander": "alex sandy sasha alec xander lex",
    "antonia": "toni tonia",
    "bartholomew": "bart barty",
    "charlotte": "lottie charlie lotte lotta",
    "constance": "connie",
    "dorothy": "dot dottie dolly dora",
    "edward": "ned ed eddie ted teddy",
    "elizabeth": "liz beth lizzie betty eliza bess",
    "francisco": "paco pancho curro kiko",
    "friedrich": "fritz fred freddy",
    "gabriela": "gabi gaby",
    "giuseppe": "beppe pino peppe",
    "hannelore": "lore hanne hanni",
    "henrietta": "etta hetty hattie",
    "ignatius": "iggy",
    "jose": "pepe",
    "josephine": "josie jo fifi",
    "katharina": "kathi kati katja kat",
    "leopold": "poldi leo",
    "margaret": "peggy maggie meg madge greta",
    "michael": "mick mike micky",
    "nathaniel": "nat nate",
    "ottilie": "tilly otti",
    "penelope": "penny nell",
    "quentin": "quin",
    "ruairi": "rory",
    "richard": "dick rick rich ricky",
    "robert": "bob rob bobby bert",
    "susannah": "sue susie sanna",
    "theodore": "theo ted teddy",
    "ulrike": "ulli uli rike",
    "veronica": "ronnie vera nica",
    "william": "bill will billy liam",
    "андрей": "андрюша",
    "анна": "аня нюра",
    "борис": "боря",
    "вера": "верочка",
    "илья": "илюша",
    "марина": "маша мариша",
    "мария": "маша",
    "олег": "олежка",
    "павел": "паша",
    "тамара": "тома",
    "юлия": "юля",
    "γιαννης": "γιαννος",
    "ελενη": "λενα λενιω",
    "νικος": "νικολας",
    "πετρος": "πετρης",
}
#: Words for nobody.
PLACEHOLDERS = frozenset(
    "unknown|unknown artist|unknownartist|various|various artists|va|n a|na|none|null|nan|nil|untitled|no artist|artist|unbekannt|unbekannter interpret|inconnu|artiste inconnu|desconocido|artista desconocido|anonymous|anon|tba|tbd|test|track|misc|diverse|not available|no name|noname|неизвестен|неизвестный исполнитель|不明|未知|xxx|todo|missing|default|undefined".split("|")
)
_CREDIT = re.compile(r"(?<=\S)[\s.,_\-–—]+(?:feat|ft|featuring|vs|versus|with|con|avec|mit|pres|presents)\b[\s.,:_\-–—]*(?=\S)", re.I)
_JOIN = re.compile(r"\s*(?:&|\+|(?<!\w)and(?!\w)|(?<!\w)und(?!\w)|(?<!\w)et(?!\w)|(?<!\w)y(?!\w)|(?<!\w)n(?!\w)|(?<!\w)x(?!\w)|;)\s*", re.I)
_SLASH = re.compile(r"\s*/\s*")
_CONNECT = frozenset("the and of n und et y de der die das le la les los las el band".split())
_NOTE = re.compile(r"[\(\[]\s*(?:official|official artist|artist|band|remaster(?:ed)?|live|us|uk)\s*[\)\]]", re.I)
_CAMEL = re.compile(r"(?<=[a-zа-яά-ώà-öø-ÿ])(?=[A-ZА-ЯΑ-ΩÀ-ÖØ-Þ])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?\.?")


def _fold(text: str) -> str:
    """Lower case, no accents."""
    out = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).lower()
    out = "".join(c for c in out if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return out.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("ς", "σ").replace("æ", "ae")


def _clean(value: str) -> str:
    value = _NOTE.sub(" ", "".join(c for c in value if unicodedata.category(c) != "Cf"))
    return re.sub(r"[\s_]+", " ", value).strip()


def all_tokens(value: str) -> list[str]:
    """Folded words, initials with their point."""
    words = _WORD.findall(_clean(value))
    split = [p for w in words for p in (_CAMEL.split(w) if len(w) > 12 and w != w.swapcase() else [w])]
    out = []
    for w in split:
        w = _fold(w).replace("'", "").replace("’", "")
        w = w if len(w) == 2 and w.endswith(".") else w.rstrip(".") + ("." if w.endswith(".") and len(w) <= 5 else "")
        if w.strip("."):
            out.append(w)
    return out


def tokens(value: str) -> list[str]:
    """Tokens that tell names apart: no articles or connectors."""
    found = all_tokens(value)
    kept = [w for w in found if w.rstrip(".") not in _CONNECT or (len(w) == 2 and w.endswith("."))]
    return kept or found


def is_credit(value: str) -> bool:
    """Whether the value names two artists."""
    text = re.sub(r"[«»\"“”\[\]()]", " ", _clean(value))
    text = re.sub(r"[\s.:,]*[\s:]+(?=[&+])|(?<=[&+])[:\s]+", " ", text)
    if _CREDIT.search(text) and all(tokens(x) for x in _CREDIT.split(text, maxsplit=1)):
        return True
    text = re.sub(r"[._\-–—•\t]+(?=\s|\S)", " ", text)
    joined = [p for p in _JOIN.split(text) if all_tokens(p)]
    if len(joined) > 2:
        return True
    # "X & the Ys" is one band; two parts of several words are two artists
    for parts in (joined, [p for p in _SLASH.split(text) if all_tokens(p)]):
        if len(parts) == 2 and min(len([t for t in all_tokens(p) if t != "the"]) for p in parts) >= 2:
            return True
    return False


@lru_cache(maxsize=WORDS)
def slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def token_counts(values: DataFrame) -> np.ndarray:
    """In how many of the values (one string column) each hashed token stands; a table of fixed size."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for v in b.column(0).to_pylist():
                counts[[slot(t.rstrip(".")) for t in set(all_tokens(v))] if v else []] += 1
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts[hit])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    sums = values.mapInArrow(local, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out


def is_title(value: str, in_titles: np.ndarray, in_names: np.ndarray) -> bool:
    """Whether nearly all words of the value are words that titles use, and names don't."""
    found = [t.rstrip(".") for t in tokens(value) if len(t.rstrip(".")) > 1]
    if not found:
        return False
    titled = sum(in_titles[slot(t)] > 3 * in_names[slot(t)] + 5 for t in found)
    return titled >= 0.8 * len(found)


def key_of(found: list[str]) -> str:
    return " ".join(sorted(t.rstrip(".") for t in found))


def bands(similarity: float = TUNED_AT, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed so that 1 - (1 - s**rows)**bands reaches the recall."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def grams(found: list[str], counts: np.ndarray, common: float) -> set[str]:
    """Padded q-grams of the distinctive tokens: those in few names, else the rarest."""
    words = sorted({t.rstrip(".") for t in found if len(t.rstrip(".")) > 1}, key=lambda t: (counts[slot(t)], t))
    kept = [t for t in words if counts[slot(t)] <= common] or words[:1] or [t.rstrip(".") for t in found]
    out = set()
    for t in kept:
        padded = "\x02" * (Q - 1) + t + "\x03" * (Q - 1)
        out.update(padded[k : k + Q] for k in range(len(padded) - Q + 1))
    return out


def combinations(found: list[str], counts: np.ndarray, common: float) -> set[int]:
    """64-bit keys of common tokens, each with the initials of the name and with each other common token."""
    words = sorted({t.rstrip(".") for t in found})
    often = [t for t in words if len(t) > 2 and counts[slot(t)] > common]
    initials = "".join(sorted(t[0] for t in found))
    keys = [f"{initials}\x02{t}" for t in often] + [f"{t}\x03{u}" for k, t in enumerate(often) for u in often[k + 1 :]]
    return {int.from_bytes(blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for k in keys}


def minhashes(gs: set[str], n: int) -> np.ndarray:
    h = np.array([zlib.crc32(g.encode()) for g in gs], np.uint64)
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 1 << 31, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 31, n, dtype=np.uint64)
    return (((h[None, :] * a[:, None] + b[:, None]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).min(axis=1)


@lru_cache(maxsize=WORDS)
def letters(word: str) -> frozenset[str]:
    return frozenset(word)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # an edit brings at most one letter that the other word lacks
    x, y = letters(a), letters(b)
    if len(x - y) > most or len(y - x) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


_SHORT = {(full, s) for full, shorts in NICKNAMES.items() for s in shorts.split()}


def inner(a: str, b: str, counts: np.ndarray) -> float:
    """Similarity of two tokens; 0 where they are different words."""
    p, q = a.rstrip("."), b.rstrip(".")
    if p == q:
        return 1.0
    if len(p) > len(q):
        p, q, a, b = q, p, b, a
    if len(p) == 1:
        return 0.9 if q.startswith(p) else 0.0
    if (q, p) in _SHORT or (p, q) in _SHORT:
        return 0.95
    if len(p) <= 4 and len(q) >= 6 and p[0] == q[0] and (a.endswith(".") or len(p) >= 3):
        at = 0
        for c in q:
            at += at < len(p) and c == p[at]
        if at == len(p) and (a.endswith(".") or q.startswith(p)):
            return 0.85
    most = 1 if len(q) <= 5 else 2
    if len(p) < 4 or len(q) - len(p) > most:
        return 0.0
    m, n = sorted((counts[slot(p)], counts[slot(q)]))
    # two words that are both well known are no typo of each other
    known = m > 3 and m > 0.25 * n
    if known and m > 20:
        return 0.0
    d = edits(p, q, 1 if known else most)
    if d > (1 if known else most):
        return 0.0
    return 1 - d / (2 * len(q))


def score(a: list[str], b: list[str], counts: np.ndarray, nodes: int, met: dict[tuple[str, str], float] | None = None) -> float:
    """Monge-Elkan similarity of two token lists; 0 where they can't name the same artist.

    ``counts``: in how many of the ``nodes`` each hashed token stands; only their shares decide how rare
    the matched words are together. ``met`` keeps what pairs of words gave, for as long as ``counts`` are the same.
    """
    met = {} if met is None else met
    if len(a) > len(b):
        a, b = b, a
    own, others = [t.rstrip(".") for t in a], [t.rstrip(".") for t in b]
    if "".join(sorted(own)) == "".join(sorted(others)):
        return 1.0
    ja, jb = "".join(own), "".join(others)
    if ja == jb and len(ja) > 5:
        return 1.0
    left, total, chance, whole = list(range(len(b))), 0.0, 1.0, len(a) == len(b)
    word = False
    for x in sorted(a, key=lambda t: (-len(t), t)):
        best, at, p = 0.0, 0, x.rstrip(".")
        for k in left:
            if others[k] == p:
                # nothing is nearer than the same word
                best, at = 1.0, -k
                break
            near = met.get((x, b[k]))
            if near is None:
                near = inner(x, b[k], counts)
                if len(met) < MET:
                    met[x, b[k]] = near
            if near > best:
                best, at = near, -k
        if best < 0.7:
            return 0.0
        left.remove(-at)
        total += best
        longer = min(counts[slot(p)], counts[slot(others[-at])])
        least = min(len(p), len(others[-at]))
        chance *= min(1.0, longer / max(nodes, FEW)) if least > 2 else INITIAL if least == 1 else 1.0
        word = word or least > 2
        whole = whole and least > 2
    # words that are common each can be rare together; a name matched word by word needs no more
    if not word or not (whole or chance <= RARE):
        return 0.0
    more = [b[k] for k in left]
    initials = sum(len(t.rstrip(".")) == 1 for t in more)
    words = [t.rstrip(".") for t in more if len(t.rstrip(".")) > 1]
    # one word may be left out, if others use it too
    if len(words) > 1 or (more and len(a) < 2) or any(counts[slot(w)] < LEFT_OUT for w in words):
        return 0.0
    return total / len(a) - 0.02 * initials - 0.1 * len(words)


_TOLD = {w for pair in _SHORT for w in pair}
#: Bits of a word's code that tell its letters, then its length, first letter, and whether it has short forms or is one.
LETTERS = 40


@lru_cache(maxsize=WORDS)
def code(word: str) -> int:
    """What of a word says that another can't be similar to it."""
    told = sum(1 << k for k in {zlib.crc32(c.encode("utf-8", "surrogatepass")) % LETTERS for c in word})
    return told | min(len(word), 63) << LETTERS | (ord(word[0]) & 255 if word else 0) << LETTERS + 6 | (word in _TOLD) << LETTERS + 14


def whole(found: list[str]) -> int:
    """The letters of all words, in an order of their own."""
    return zlib.crc32("".join(sorted("".join(t.rstrip(".") for t in found))).encode("utf-8", "surrogatepass"))


def possible(x: str, y: str) -> str:
    """SQL: whether two names (``codes``, ``whole``) can have a score above 0, each word of the shorter one a similar word in the other.

    Never false where ``score`` isn't 0: ``inner`` asks for two edits at most, the same first letter before an initial or
    abbreviation, or a nickname.
    """
    m = (1 << LETTERS) - 1
    near = f"bit_count(s & ~t & {m}L) <= 2 and bit_count(t & ~s & {m}L) <= 2 and abs((shiftright(s, {LETTERS}) & 63) - (shiftright(t, {LETTERS}) & 63)) <= 2"
    begins = f"(shiftright(s ^ t, {LETTERS + 6}) & 255) = 0 and least(shiftright(s, {LETTERS}) & 63, shiftright(t, {LETTERS}) & 63) <= 4"
    told = f"(shiftright(s & t, {LETTERS + 14}) & 1) = 1"
    less, more = (f"case when size({x}.codes) {op} size({y}.codes) then {a}.codes else {b}.codes end" for op, a, b in (("<=", x, y), ("<=", y, x)))
    return f"{x}.whole = {y}.whole or forall({less}, s -> exists({more}, t -> ({near}) or ({begins}) or {told}))"


def names(records: DataFrame, name: str = "artist", title: str = "title") -> DataFrame:
    """(name, n, key, tokens) of every distinct value that names one artist."""
    counted = records.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n"))
    # few bytes, much work: as many tasks as any shuffle has
    counted = durable(counted.repartition(shuffle_partitions(records.sparkSession)))
    titles = records.select(F.col(title).cast("string").alias("v")).where("v is not null").distinct()
    in_names, in_titles = token_counts(counted.select("name")), token_counts(titles)
    model = garbled_text.fit(records, (title, name))
    shared = records.sparkSession.sparkContext.broadcast((in_names, in_titles, model))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_names, in_titles, model = shared.value
        for pdf in batches:
            values = pdf["name"].tolist()
            bad = [hit for hit, _ in garbled_text.restore(values, model)]
            out = []
            for v, n, garbled in zip(values, pdf["n"], bad, strict=True):
                found = tokens(v)
                plain = " ".join(t.rstrip(".") for t in all_tokens(v))
                if garbled or not found or plain in PLACEHOLDERS or plain.replace(" ", "") in PLACEHOLDERS or is_credit(v) or is_title(v, in_titles, in_names):
                    continue
                out.append((v, n, key_of(found), found))
            yield pd.DataFrame(out, columns=["name", "n", "key", "tokens"])

    return counted.mapInPandas(keep, "name string, n bigint, key string, tokens array<string>")


def links(nodes: DataFrame, counts: np.ndarray, n: int) -> DataFrame:
    """(a, b, score): verified pairs of the ``n`` nodes (key, tokens)."""
    # only proposes: tokens in more nodes than this propose pairs in combination, not alone
    common = max(60.0, 0.004 * n)
    b_n = bands()
    shared = nodes.sparkSession.sparkContext.broadcast(counts)

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, band, codes, letters_ = [], [], [], []
            for k, found in zip(pdf["key"], pdf["tokens"], strict=True):
                h = minhashes(grams(list(found), shared.value, common), b_n * ROWS).reshape(b_n, ROWS)
                band.append(h[:, 0] * np.uint64(0x9E3779B97F4A7C15) + h[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[:, 2] * np.uint64(0x165667B19E3779F9) + np.arange(b_n, dtype=np.uint64))
                more = combinations(list(found), shared.value, common)
                band.append(np.array(sorted(more), np.int64).view(np.uint64))
                key += [k] * (b_n + len(more))
                codes += [[code(t.rstrip(".")) for t in found]] * (b_n + len(more))
                letters_ += [whole(list(found))] * (b_n + len(more))
            yield pd.DataFrame({"key": key, "band": np.concatenate(band).view(np.int64) if band else np.zeros(0, np.int64), "codes": codes, "whole": np.array(letters_, np.int64)})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[tuple[str, str], float] = {}
        for pdf in batches:
            if len(met) >= MET:
                met.clear()
            s = [score(list(x), list(y), shared.value, n, met) for x, y in zip(pdf["ta"], pdf["tb"], strict=True)]
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "score": s})
            yield out[out["score"] >= LEAST_SCORE]

    rows = durable(nodes.select("key", "tokens").mapInPandas(banded, "key string, band bigint, codes array<bigint>, whole bigint"))
    # most that meet in a band can't be similar: they are told apart where they meet, and go no further
    pairs = rows.alias("x").join(rows.alias("y"), F.col("x.band") == F.col("y.band")).where("x.key < y.key").where(possible("x", "y")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    full = pairs.join(nodes.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a").join(nodes.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    return full.mapInPandas(verify, "a string, b string, score double")


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, centre): star clusters; ``nodes``: (key, weight). In each round every open node that outweighs
    its open neighbours becomes a centre, and its neighbours, each at their best centre, its satellites."""
    both = durable(edges.select("a", "b", "score").union(edges.select("b", "a", "score")))
    open_ = durable(nodes.select("key", "weight"))
    done = None
    while True:
        rank = F.struct("weight", "key")
        near = both.join(open_.select(F.col("key").alias("a")), "a").join(open_.select(F.col("key").alias("b"), rank.alias("r")), "b")
        best = near.groupBy("a").agg(F.max("r").alias("r")).withColumnRenamed("a", "key")
        centres = open_.join(best, "key", "left").where(F.col("r").isNull() | (rank > F.col("r"))).select("key")
        centres = durable(centres)
        pick = F.max(F.struct("score", "r"))
        heads = open_.join(centres, "key").select(F.col("key").alias("b"), F.struct("weight", "key").alias("r"))
        held = both.join(open_.select(F.col("key").alias("a")), "a").join(heads, "b").groupBy("a").agg(pick.alias("p")).select(F.col("a").alias("key"), F.col("p.r.key").alias("centre"))
        now = centres.select("key", F.col("key").alias("centre")).union(held.join(centres, "key", "left_anti").select("key", "centre"))
        done = durable(now if done is None else done.union(now))
        open_ = durable(open_.join(done.select("key"), "key", "left_anti"))
        if not open_.limit(1).count():
            return done


def linked(records: DataFrame, name: str = "artist", title: str = "title") -> DataFrame:
    """(name, n, entity): every spelling and the key of the entity it names."""
    spelled = durable(names(records, name, title))
    nodes = durable(spelled.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("tokens", F.struct("n", "name")).alias("tokens")))
    counts = token_counts(nodes.select(F.concat_ws(" ", "tokens").alias("v")))
    edges = links(nodes, counts, nodes.count())
    initial = F.exists("tokens", lambda t: F.length(F.rtrim(F.replace(t, F.lit("."), F.lit("")))) <= 1)
    weight = F.col("n").cast("double") * F.when(initial, 1e-6).otherwise(1.0)
    return spelled.join(stars(nodes.select("key", weight.alias("weight")), edges), "key").select("name", "n", F.col("centre").alias("entity"))


def pairs(spellings: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of spellings of one entity."""
    a, b = spellings.select("entity", F.col("name").alias("name_a")), spellings.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
