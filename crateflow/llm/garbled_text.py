"""Text that was decoded with the wrong character encoding: found, and restored where possible.

A hidden Markov model labels the characters of a value: one clean state, and one state per encoding
pair (the true encoding, and the one wrongly used). A state explains the observed characters by those
that its inverse transform yields, so one model of clean text, character bigrams counted over the
corpus' values, gives the emissions of every state. Viterbi decoding finds the spans; each span gets its
state's inverse transform. The first counts leave out values with impossible characters or with
sequences that are valid UTF-8 under some single-byte code; then values are labelled and counted again.
Restored text is labelled once more, so text garbled twice is undone twice.

The model is a hashed table of fixed size: its broadcast doesn't grow with the data.

Defined cases: null, empty and pure ASCII values are clean (but for entities that stand for garbled
letters). U+FFFD makes a value garbled and not restorable. Values of any length are read whole; repeated
values get equal results; ties go to the clean state. Empty tables give empty results; other columns
are kept out of the result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.session import durable, shuffle_partitions

#: Single-byte codes in which UTF-8 bytes get shown.
SHOWN_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "cp1254", "koi8_r", "cp866", "iso8859_2")
#: (true, wrongly used) single-byte codes.
LEGACY = (
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1250", "cp1252"),
    ("iso8859_2", "cp1252"),
    ("cp1251", "cp1252"),
    ("cp1253", "cp1252"),
    ("cp1254", "cp1252"),
    ("koi8_r", "cp1252"),
    ("cp866", "cp1252"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
)
#: Double-byte codes shown in cp1252.
DOUBLE = ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr")

TABLE = 1 << 20
SMOOTH = 3.0
ENTER, LEAVE, INSIDE_WORD = -5.0, -0.5, -8.0
LAYERS = 3
_ENTITY = re.compile(r"&(?:[A-Za-z]+[0-9]*|#\d+|#x[0-9A-Fa-f]+);")
LOST = 0xFFFD


@cache
def _decoded(code: str) -> np.ndarray:
    """Code point of each byte; bytes a code doesn't define stand for the control of that number."""
    out = np.arange(256)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(code))
        except UnicodeDecodeError:
            pass
    return out


@cache
def _byte_of(code: str) -> np.ndarray:
    """Byte of each code point in the basic plane, -1 where the code has none."""
    out = np.full(65536, -1, np.int16)
    out[0x80:0xA0] = np.arange(0x80, 0xA0)  # controls pass through most decoders
    out[_decoded(code)] = np.arange(256)
    return out


@cache
def _folded_byte_of(code: str) -> np.ndarray:
    """As ``_byte_of``, for text whose case was changed after it was garbled."""
    out = _byte_of(code).copy()
    for b in range(128, 256):
        c = chr(_decoded(code)[b])
        for other in (c.lower(), c.upper()):
            if len(other) == 1 and other != c and ord(other) < 65536:
                at = int(out[ord(other)])
                # of two bytes, prefer the lead byte for letters that UTF-8 needs as leads
                if at < 0 or (0xC2 <= b <= 0xD1 and at > 0xD1) or (0x80 <= b < 0xC0 and at >= 0xE0):
                    out[ord(other)] = b
    return out


@cache
def _lower() -> np.ndarray:
    """Symbol of each code point: lower case; large scripts and punctuation as one symbol each."""
    out = np.arange(65536)
    for c in range(65536):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) < 65536:
            out[c] = ord(low)
    for lo, hi, symbol in ((0x3040, 0x309F, 0x3042), (0x30A0, 0x30FF, 0x30A2), (0x3400, 0x9FFF, 0x4E00), (0xAC00, 0xD7A3, 0xAC00), (0x300, 0x36F, 0x300), (0xE000, 0xF8FF, 0xE000)):
        out[lo : hi + 1] = symbol
    out[[ord(c) for c in "«»“”‘’…–—•―"]] = ord("«")
    out[[0xA0, 0xAD, 0x200B, 0x2009, 0x2002, 0x2003, 0x202F, 0xFEFF, 0x200C, 0x200D, 0x200E]] = 0xA0
    return out


#: Ranges whose code points share a symbol, and are told apart by their own counts.
LARGE = ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xE000, 0xF8FF))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint32) * np.uint32(2654435761)) ^ (b.astype(np.uint32) * np.uint32(40503) + np.uint32(0x9E37))) % np.uint32(TABLE)


@dataclass
class Model:
    """Bigram counts of clean text, hashed."""

    pairs: np.ndarray = field(default_factory=lambda: np.zeros(TABLE, np.float32))
    single: np.ndarray = field(default_factory=lambda: np.zeros(65536, np.float32))
    raw: np.ndarray = field(default_factory=lambda: np.zeros(65536, np.float32))

    def spread(self) -> np.ndarray:
        """Log share of each code point in its symbol."""
        if not hasattr(self, "_spread"):
            self._spread = np.zeros(65536)
            for lo, hi in LARGE:
                n = self.raw[lo : hi + 1] + 0.02
                self._spread[lo : hi + 1] = np.log(n / n.sum())
        return self._spread

    def log_p(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        a, b = _lower()[before], _lower()[now]
        total = self.single.sum()
        prior = (self.single[b] + 0.02) / (total + 0.02 * 65536)
        # a value that was counted itself must not vouch for its own bigrams
        seen = np.maximum(self.pairs[_pair(a, b)] - 1, 0)
        return np.log((seen + SMOOTH * prior) / (self.single[a] + SMOOTH)) + self.spread()[now]


@cache
def _letters() -> np.ndarray:
    """Code points that stand inside words, or may stand for what does once decoded."""
    return np.array([c > 0 and (c >= 0x80 and c not in (0xA0, 0x2009) or chr(c).isalnum()) for c in range(65536)])


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, one row each, padded with 0; a 0 stands before each text."""
    width = max(map(len, texts)) + 1
    out = np.zeros((len(texts), width), np.int64)
    for i, t in enumerate(texts):
        out[i, 1 : len(t) + 1] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    out[out > 0xFFFF] = 0xE000
    return out


def _units_utf8(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(decoded code point at a unit's first byte or -1, continuation flag) of UTF-8 in byte rows (-1: no byte)."""
    nxt = [np.pad(raw[:, k:], ((0, 0), (0, k)), constant_values=-1) for k in (1, 2, 3)]
    tail = [(x >= 0x80) & (x < 0xC0) for x in nxt]
    two = (raw >= 0xC2) & (raw <= 0xDF) & tail[0]
    three = (raw >= 0xE0) & (raw <= 0xEF) & tail[0] & tail[1]
    low = [x & 0x3F for x in nxt]
    value = np.where((raw >= 0) & (raw < 0x80), raw, -1)
    value = np.where(two, ((raw & 0x1F) << 6) | low[0], value)
    wide = ((raw & 0x0F) << 12) | (low[0] << 6) | low[1]
    three &= (wide >= 0x800) & ((wide < 0xD800) | (wide > 0xDFFF))
    value = np.where(three, wide, value)
    more = np.zeros(raw.shape, bool)
    more[:, 1:] |= two[:, :-1] | three[:, :-1]
    more[:, 2:] |= three[:, :-2]
    return np.where(more, -1, value), more


def _units_double(raw: np.ndarray, code: str) -> tuple[np.ndarray, np.ndarray]:
    value, more = np.where((raw >= 0) & (raw < 0x80), raw, -1), np.zeros(raw.shape, bool)
    for i in np.flatnonzero((raw >= 0x80).sum(axis=1) >= 2):
        row, at = raw[i], 0
        while at < len(row):
            if row[at] >= 0x80:
                for n in (2, 1):
                    part = row[at : at + n]
                    if len(part) == n and (part >= 0).all():
                        try:
                            c = bytes(part.astype(np.uint8)).decode(code)
                        except UnicodeDecodeError:
                            continue
                        if len(c) == 1 and ord(c) >= 0x80:
                            value[i, at], more[i, at + 1 : at + n] = ord(c), True
                            value[i, at + 1 : at + n] = -1
                            at += n - 1
                            break
            at += 1
    return value, more


def states(points: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, float]]:
    """(name, decoded code points, continuation flags, extra cost) of each pair state over the rows."""
    none = np.zeros(points.shape, bool)
    for code in SHOWN_AS:
        for fold, table in ((0.0, _byte_of(code)), (-2.5, _folded_byte_of(code))):
            raw = table[points].astype(np.int64)
            if (raw >= 0xC2).any():
                yield f"utf8>{code}" + "~" * (fold < 0), *_units_utf8(raw), fold
    for true, shown in LEGACY:
        raw = _byte_of(shown)[points].astype(np.int64)
        yield f"{true}>{shown}", np.where(raw >= 0, _decoded(true)[raw], -1), none, -1.0
    for code in DOUBLE:
        raw = _byte_of("cp1252")[points].astype(np.int64)
        yield f"{code}>cp1252", *_units_double(raw, code), -20.0


def label(texts: list[str], model: Model) -> list[tuple[bool, str]]:
    """(garbled, restored text) of each text; one layer."""
    points = _points(texts)
    ends = np.array([len(t) for t in texts])
    rows, width = points.shape
    there = np.arange(width)[None, :] <= ends[:, None]
    before = np.pad(points[:, :-1], ((0, 0), (1, 0)))
    clean = model.log_p(before, points)
    names, values, mores, emits, costs = [], [], [], [], []
    for name, value, more, cost in states(points):
        changed = (value >= 0) & (value != points) & (value >= 0x80) & there
        if not changed.any():
            continue
        starts = np.where(value >= 0, np.arange(width)[None, :], 0)
        at = np.maximum.accumulate(starts, axis=1)
        last = np.pad(at[:, :-1], ((0, 0), (1, 0)))
        own = np.where(value >= 0, value, points)
        emit = np.where(value >= 0, model.log_p(np.take_along_axis(own, last, axis=1), np.where(value >= 0, value, 0)), -np.inf)
        # control characters are never restored text
        emit = np.where((own >= 0x80) & (own < 0xA0) & (value >= 0), -np.inf, emit)
        emits.append(np.where(more, 0.0, emit))
        names.append(name), values.append(value), mores.append(more), costs.append(cost)
    if not names:
        return [(LOST in map(ord, t), t) for t in texts]
    emit, more, value = np.stack(emits), np.stack(mores), np.stack(values)
    n = len(names)
    cost = np.array(costs)[:, None]
    letter = _letters()[points]
    mid = np.where(letter & np.pad(letter[:, :-1], ((0, 0), (1, 0))), INSIDE_WORD, 0.0)
    # Viterbi over clean (row of zeros in `frm`: 0 stays/enters clean; k+1 comes from state k)
    c, p = np.zeros(rows), np.full((n, rows), -np.inf)
    to_clean, to_pair = np.zeros((width, rows), np.int16), np.zeros((width, n, rows), bool)
    for t in range(1, width):
        inside = more[:, :, t]
        out = np.where(inside, -np.inf, p + LEAVE + mid[:, t])
        best = out.argmax(axis=0)
        from_pair = out[best, np.arange(rows)]
        to_clean[t] = np.where(from_pair > c, best + 1, 0)
        enter = np.where(inside, -np.inf, c[None, :] + ENTER + cost + mid[None, :, t])
        to_pair[t] = p >= enter
        new_c = np.maximum(c, from_pair) + clean[:, t]
        new_p = np.maximum(p, enter) + emit[:, :, t]
        live = t <= ends
        c, p = np.where(live, new_c, c), np.where(live, new_p, p)
    final = np.where(np.pad(more[:, :, 1:], ((0, 0), (0, 0), (0, 1)))[:, np.arange(rows), ends], -np.inf, p + LEAVE)
    out = []
    for i, text in enumerate(texts):
        best = int(final[:, i].argmax())
        s = best if final[best, i] > c[i] else -1
        path = []
        for t in range(int(ends[i]), 0, -1):
            path.append(s)
            if s < 0:
                s = int(to_clean[t, i]) - 1
            elif not to_pair[t, s, i]:
                s = -1
        path.reverse()
        hit, made = LOST in map(ord, text), []
        for t, s in enumerate(path):
            if s < 0:
                made.append(text[t])
            elif not more[s, i, t + 1]:
                v = int(value[s, i, t + 1])
                made.append(chr(v))
                was = int(points[i, t + 1])
                # spaces that don't show are a matter of format, not of encoding
                hit |= v != was and v >= 0x80 and _lower()[v] != 0xA0 and _lower()[was] != 0xA0
        out.append((bool(hit), "".join(made)))
    return out


def _plain(value: str) -> str:
    if "&" in value and _ENTITY.search(value):
        value = html.unescape(value)
    return unicodedata.normalize("NFC", value)


def restore(values: list[str], model: Model) -> list[tuple[bool, str]]:
    """(garbled, restored) of each value, all layers."""
    texts = [_plain(v) for v in values]
    out = [(False, v) for v in values]
    waiting = sorted((i for i, t in enumerate(texts) if not t.isascii()), key=lambda i: len(texts[i]))
    for layer in range(LAYERS):
        again = []
        at = 0
        while at < len(waiting):
            # rows of like length go together; a block holds a bounded number of characters
            size = max(1, min(256, 16384 // (len(texts[waiting[at]]) + 8)))
            block = waiting[at : at + size]
            at += size
            for i, (hit, made) in zip(block, label([texts[i] for i in block], model), strict=True):
                if hit:
                    out[i] = True, made
                    if made != texts[i] and not made.isascii() and layer + 1 < LAYERS:
                        texts[i] = made
                        again.append(i)
        waiting = again
    return out


#: Signs that don't stand right after a letter in clean text, and quotes that don't stand between letters.
_ODD = re.compile(r"[^\W\d_](?:[¡-©¬®-±´-¸»-¿×÷ˆ-˝†‡‰‹›€™√-≥◊∂∆∏∑∙ⁿ₧⌐⌠⌡¬]|[“”„‚«»‘–—…](?=[^\W\d_]))")
_SWAPPED = re.compile(r"\b[^\W\d_A-Za-z]?[а-яё][А-ЯЁ]{2,}")


def _suspect(texts: list[str]) -> np.ndarray:
    """Values that can't be clean as they stand, or hold UTF-8 seen through a single-byte code.

    Words in swapped case aren't counted either: Cyrillic codes are taken for each other that way.
    """
    points = _points(texts)
    bad = np.array([bool(_SWAPPED.search(t) or _ODD.search(t)) for t in texts]) | ((points == LOST) | ((points >= 0x80) & (points < 0xA0)) | ((points >= 0x2500) & (points < 0x25A0))).any(axis=1)
    for code in SHOWN_AS:
        for table in (_byte_of(code), _folded_byte_of(code)):
            value, more = _units_utf8(table[points].astype(np.int64))
            # in cp866 plain words look like three-byte units: only two-byte ones, with their box signs, tell
            most = 0x800 if code == "cp866" else 0x10000
            bad |= ((value >= 0xA0) & (value < most) & (np.pad(more[:, 1:], ((0, 0), (0, 1))))).any(axis=1)
    return bad


def count_clean(values: DataFrame, model: Model | None) -> Model:
    """Character bigrams over all (distinct) values that are clean: by the model, or at first not suspect."""
    shared = None if model is None else values.sparkSession.sparkContext.broadcast(model)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, single, raws = np.zeros(TABLE, np.int64), np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for b in batches:
            column = b.column(0).dictionary_encode()
            kept = [_plain(v) if v is not None else "" for v in column.dictionary.to_pylist()]
            raw = [(i, t) for i, t in enumerate(kept) if t and not t.isascii()]
            raw.sort(key=lambda x: len(x[1]))
            for s in range(0, len(raw), 512):
                block = raw[s : s + 512]
                texts = [t for _, t in block]
                good = ~_suspect(texts) if shared is None else ~np.array([hit for hit, _ in restore(texts, shared.value)])
                block = [x for x, g in zip(block, good, strict=True) if g]
                if not block:
                    continue
                exact = _points([t for _, t in block])
                points = _lower()[exact]
                live = (np.arange(points.shape[1])[None, :] <= np.array([len(t) for _, t in block])[:, None])[:, 1:]
                pairs += np.bincount(_pair(points[:, :-1], points[:, 1:])[live], minlength=TABLE).astype(np.int64)
                single += np.bincount(points[:, :-1][live], minlength=65536).astype(np.int64)
                raws += np.bincount(exact[:, 1:][live], minlength=65536).astype(np.int64)
        for key, counts in ((0, pairs), (1, single), (2, raws)):
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), key, np.int32)), pa.array(hit.astype(np.int32)), pa.array(counts[hit])], names=["kind", "slot", "n"])

    sums = values.mapInArrow(local, "kind int, slot int, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, at, n = (sums.column(c).to_numpy() for c in ("kind", "slot", "n"))
    out = Model()
    out.pairs[at[kind == 0]] = n[kind == 0]
    out.single[at[kind == 1]] = n[kind == 1]
    out.raw[at[kind == 2]] = n[kind == 2]
    return out


def _values(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The values that could be garbled, one column."""
    one = records.select(F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("value"))
    return one.where(F.col("value").rlike(r"[^\x00-\x7F]|&[A-Za-z#]"))


def fit(records: DataFrame, fields: tuple[str, ...], rounds: int = 2) -> Model:
    # few bytes, much work: as many tasks as any shuffle has
    values = durable(_values(records, fields).distinct().repartition(shuffle_partitions(records.sparkSession)))
    model = count_clean(values, None)
    for _ in range(rounds - 1):
        model = count_clean(values, model)
    return model


def garbled(records: DataFrame, fields: tuple[str, ...] = ("title", "artist"), id_col: str = "id", model: Model | None = None) -> DataFrame:
    """(id, field_name, value, restored): every garbled value; ``restored`` is null where text was lost."""
    shared = records.sparkSession.sparkContext.broadcast(model or fit(records, fields))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2).dictionary_encode()
            found = restore(column.dictionary.to_pylist(), shared.value)
            at = column.indices.to_pylist()
            keep = [k for k, i in enumerate(at) if found[i][0]]
            made = [None if chr(LOST) in found[at[k]][1] else found[at[k]][1] for k in keep]
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.string())], names=["id", "field_name", "value", "restored"])

    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields]))
    long = records.select(F.col(id_col).cast("bigint").alias("id"), each.alias("e")).select("id", "e.field_name", "e.value")
    return long.where(F.col("value").rlike(r"[^\x00-\x7F]|&[A-Za-z#]")).mapInArrow(find, "id bigint, field_name string, value string, restored string")
