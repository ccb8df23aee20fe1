"""Scalar functions of the engine as column expressions; all stay inside the JVM.

Vectors are ``array<double>``. Numbers follow binary floating point in the order written here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The axes of a feature vector, in order.
AXIS_NAMES = (
    "duration_sec",
    "loudness.integrated",
    "loudness.range",
    "tempo.bpm",
    "tempo.confidence",
    "key.confidence",
    "spectral.centroid",
    "spectral.rolloff",
    "spectral.flatness",
    "rhythm.danceability",
    "rhythm.onset_rate",
    "mood.happy",
    "mood.sad",
    "mood.aggressive",
    "mood.relaxed",
    "mood.electronic",
    "mood.party",
    "mood.acoustic",
    "key.fifths_x",
    "key.fifths_y",
)
#: Fixed value: the stamp of the axes above.
SCHEMA_HASH = "1d7ffa6e308d"
MOODS = ("happy", "sad", "aggressive", "relaxed", "electronic", "party", "acoustic")
#: Keys in the order of fifths, and spellings of the same key.
FIFTHS = ("C", "G", "D", "A", "E", "B", "F#", "Db", "Ab", "Eb", "Bb", "F")
ENHARMONIC = {"C#": "Db", "D#": "Eb", "Gb": "F#", "G#": "Ab", "A#": "Bb", "B#": "C", "E#": "F", "Cb": "B", "Fb": "E"}
SLOTS = 24


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    # the norm stands outside the lambda: inside, it would be computed anew for every element
    norms = F.array_repeat(F.sqrt(dot(v, v)), F.size(v))
    return F.zip_with(v, norms, lambda x, n: F.when(n > 0, x / n).otherwise(0.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine, not clamped; raises on empty vectors or different lengths."""
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fine, dot(l2_normalize(a), l2_normalize(b))).otherwise(F.raise_error(F.lit("vectors must have one length above 0")).cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine clamped to [-1, 1]; two zero vectors 0, one zero vector 1."""
    za, zb = dot(a, a) == 0, dot(b, b) == 0
    return F.when(za & zb, 0.0).when(za | zb, 1.0).otherwise(1 - F.greatest(F.least(cosine_similarity(a, b), F.lit(1.0)), F.lit(-1.0)))


def rms_distance(a: Column, b: Column) -> Column:
    """Root of the mean squared difference."""
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def weighted_distance(a: Column, b: Column, sigma: list[float] | None, weights: list[float] | None = None) -> Column:
    """Standardised distance: root of the weighted mean of squared differences over deviations.

    A deviation of 0 counts as 1, a missing weight as 1; without deviations no weights apply. A null
    vector is infinitely far; vectors of different lengths are an error.
    """
    if not sigma:
        d = rms_distance(a, b)
    else:
        n = len(sigma)
        scale = F.array(*[F.lit(float((weights[k] if weights and k < len(weights) else 1.0)) / float(s or 1.0) ** 2) for k, s in enumerate(sigma)])
        sq = F.zip_with(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)), scale, lambda x, w: x * w)
        d = F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / F.least(F.size(a), F.lit(n)))
    odd = F.raise_error(F.lit("vectors must have one length")).cast("double")
    return F.when(a.isNull() | b.isNull(), float("inf")).when(F.size(a) != F.size(b), odd).otherwise(d)


def normalise_key_name(name: Column) -> Column:
    """One of the twelve key names, or null."""
    text = F.trim(name)
    canon = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))
    canon = F.coalesce(F.try_element_at(_lookup(ENHARMONIC), canon), canon)
    return F.when(canon.isin(*FIFTHS), canon)


def parse_mode(mode: Column, scale: Column) -> Column:
    """``major`` or ``minor`` out of the mode, or where that is empty out of the scale; else null."""
    text = F.lower(F.coalesce(F.nullif(mode, F.lit("")), scale, F.lit("")))
    return F.when(text.contains("major"), "major").when(text.contains("minor"), "minor")


def key_slot(name: Column, mode: Column, scale: Column | None = None) -> Column:
    """Place on the circle of 24: major keys even, each minor key next to its relative major; or null."""
    kind = parse_mode(mode, F.lit(None).cast("string") if scale is None else scale)
    major = F.try_element_at(_lookup({k: 2 * i for i, k in enumerate(FIFTHS)}), normalise_key_name(name))
    return F.when(kind == "major", major).when(kind == "minor", F.pmod(major - 6 + SLOTS, F.lit(SLOTS)) + 1)


def key_steps(a: Column, b: Column) -> Column:
    """Circular distance of two slots, 0 to 12; null if either is."""
    d = F.abs(a - b) % SLOTS
    return F.when(a.isNotNull() & b.isNotNull(), F.least(d, SLOTS - d))


def key_verdict(steps: Column, most: int = 2) -> Column:
    return F.when(steps.isNull() | (steps <= most), "allow").when(steps <= most + 2, "penalise").otherwise("block")


def key_to_circle(slot: Column) -> tuple[Column, Column]:
    """Unit-circle coordinates of a slot; the origin for none."""
    angle = slot * F.pi() / 12
    return F.coalesce(F.cos(angle), F.lit(0.0)), F.coalesce(F.sin(angle), F.lit(0.0))


def tempo_ok(seed: Column, candidate: Column, share: float = 0.10, centre: Column | None = None) -> Column:
    """Whether the candidate lies within a share of the centre; false for a centre of 0 or null."""
    c = seed if centre is None else F.coalesce(centre, seed)
    return F.when(c > 0, F.abs(candidate - c) / c <= share).otherwise(False)


def mood_passes(axis: dict[str, Column], box: dict[str, dict[str, float]]) -> Column:
    """Conjunction of inclusive bounds; a missing axis fails. Axis names may carry a group before a point."""
    out = F.lit(True)
    for name, bounds in box.items():
        v = axis[name.split(".", 1)[-1]]
        ok = v.isNotNull()
        if "min" in bounds:
            ok &= v >= float(bounds["min"])
        if "max" in bounds:
            ok &= v <= float(bounds["max"])
        out &= F.coalesce(ok, F.lit(False))
    return out


def relax_mood_box(box: dict[str, dict[str, float]], step: float = 0.1) -> dict[str, dict[str, float]]:
    """Bounds moved outwards by a step, inside [0, 1]; repeated steps add up as floating point does."""
    return {k: {e: max(0.0, b[e] - step) if e == "min" else min(1.0, b[e] + step) for e in ("min", "max") if e in b} for k, b in box.items()}


def title_contains(title: Column, wanted: str) -> Column:
    """Plain containment without regard to case; null titles are empty."""
    return F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(wanted.lower()))


def is_stale(sidecar: Column, version: Column, stamp: Column, current: str | None, current_stamp: str | None) -> Column:
    """Whether a stored sidecar must be extracted again."""
    out = sidecar.isNull()
    if current is not None:
        out |= ~version.eqNullSafe(F.lit(current))
    if current_stamp is not None:
        out |= stamp.isNotNull() & (stamp != current_stamp)
    return out
