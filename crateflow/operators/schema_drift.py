"""Sidecars whose fields drift from batch to batch: one typed table, and a report of each change.

Every sidecar is reduced, inside the JVM, to a *fingerprint*: the canonical schema of its parsed
value (sorted keys, all number kinds alike). A library has few fingerprints, so the migration steps
run once per distinct fingerprint instead of once per file. A fingerprint is routed through the
chained ``STEPS``: each renames paths of one generation of extractors to those of the next; what is
left is compared with the reference schema. ``unify`` applies the same chain to the values, followed
by cast and default rules.

Defined cases: a null, unparsable, non-object or empty sidecar has no fields, takes no part in the
report and yields a row of nulls in ``unify``. A null leaf is present, a null or empty group is
absent. Repeated rows count once in the report. If a field stands in its own place and at an old
path too, the old path is an added field. Extra columns are ignored by the report.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reference fields a sidecar can hold, and their kinds.
FIELDS = {
    "version": "string",
    "schema_hash": "string",
    "duration_sec": "number",
    "loudness.integrated": "number",
    "loudness.range": "number",
    "tempo.bpm": "number",
    "tempo.confidence": "number",
    "key.key": "string",
    "key.mode": "string",
    "key.scale": "string",
    "key.confidence": "number",
    "spectral.centroid": "number",
    "spectral.rolloff": "number",
    "spectral.flatness": "number",
    "rhythm.danceability": "number",
    "rhythm.onset_rate": "number",
    "mood.happy": "number",
    "mood.sad": "number",
    "mood.aggressive": "number",
    "mood.relaxed": "number",
    "mood.electronic": "number",
    "mood.party": "number",
    "mood.acoustic": "number",
}


@dataclass(frozen=True)
class Step:
    """One migration: old path -> path of the next generation; ``group.*`` moves a whole group."""

    name: str
    renames: tuple[tuple[str, str], ...]


#: The chain, oldest generation first; a path may be renamed by several steps in turn.
STEPS = (
    Step("flat names become groups", (("loudness_*", "loudness.*"), ("spectral_*", "spectral.*"), ("mood_*", "mood.*"), ("tempo_*", "tempo.*"), ("rhythm_*", "rhythm.*"), ("key_*", "key.*"))),
    Step("scalars become groups", (("tempo", "tempo.bpm"), ("key", "key.scale"))),
    Step("groups get their present names", (("moods.*", "mood.*"), ("timbre.*", "spectral.*"), ("extractor.version", "version"), ("rhythm.bpm", "tempo.bpm"))),
    Step(
        "leaves get their present names",
        (
            ("duration", "duration_sec"),
            ("loudness.integrated_lufs", "loudness.integrated"),
            ("loudness.lra", "loudness.range"),
            ("tempo.BPM", "tempo.bpm"),
            ("tempo.beats_per_minute", "tempo.bpm"),
            ("tempo.conf", "tempo.confidence"),
            ("key.tonic", "key.key"),
            ("key.tonality", "key.mode"),
            ("spectral.brightness_hz", "spectral.centroid"),
            ("rhythm.dance", "rhythm.danceability"),
            ("rhythm.onsetRate", "rhythm.onset_rate"),
            ("mood.partying", "mood.party"),
        ),
    ),
)


def _renamed(path: str, old: str, new: str) -> str | None:
    if old.endswith("*"):
        return new[:-1] + path[len(old) - 1 :] if path.startswith(old[:-1]) else None
    return new if path == old else None


def _plain(path: str) -> str:
    return re.sub(r"[^a-z0-9]", "", path.lower())


def migrate(path: str, fields: dict[str, str] = FIELDS) -> str:
    """Where ``path`` stands after all steps; a mere respelling of a field's path is that field."""
    if path in fields:
        return path
    for step in STEPS:
        for old, new in step.renames:
            if (at := _renamed(path, old, new)) is not None:
                path = at
                break
    if path not in fields:
        path = next((f for f in fields if _plain(f) == _plain(path)), path)
    return path


def parse_fingerprint(text: str) -> dict[str, object]:
    """``OBJECT<a: NUMBER, b: OBJECT<...>>`` as nested dicts; other kinds stay text."""
    at = 0

    def value() -> object:
        nonlocal at
        if text.startswith("OBJECT<", at):
            at += 7
            out: dict[str, object] = {}
            while text[at] != ">":
                if text[at] == "`":
                    end = at + 1
                    while text[end] != "`" or text[end + 1 : end + 2] == "`":
                        end += 2 if text[end] == "`" else 1
                    key, at = text[at + 1 : end].replace("``", "`"), end + 1
                else:
                    end = text.index(":", at)
                    key, at = text[at:end], end
                at += 2
                out[key] = value()
                if text.startswith(", ", at):
                    at += 2
            at += 1
            return out
        start, depth = at, 0
        while at < len(text) and (depth or text[at] not in ",>"):
            depth += (text[at] == "<") - (text[at] == ">")
            at += 1
        return text[start:at]

    return value()  # type: ignore[return-value]


def leaves(tree: dict[str, object], fields: dict[str, str] = FIELDS, under: str = "") -> Iterator[tuple[str, str]]:
    """Path and kind of every leaf. The value of a reference field is a leaf whatever it holds."""
    groups = {f[:k] for f in fields for k, c in enumerate(f) if c == "."}
    for key, kind in tree.items():
        path = f"{under}.{key}" if under else key
        if isinstance(kind, dict) and path not in fields:
            yield from leaves(kind, fields, path)
        elif not (kind == "VOID" and path in groups):
            yield path, "OBJECT" if isinstance(kind, dict) else str(kind)


def changes(fingerprint: str, fields: dict[str, str] = FIELDS) -> list[tuple[str, str, str]]:
    """(field, kind of change, seen path) of one fingerprint; kind ``present`` where nothing changed."""
    found = dict(leaves(parse_fingerprint(fingerprint), fields))
    kinds, out = {"string": "STRING", "number": "NUMBER"}, []
    for path, kind in found.items():
        field = migrate(path, fields)
        if field not in fields or (path != field and field in found):
            out.append((path, "added", path))
            continue
        out.append((field, "present" if path == field else "renamed", path))
        if kind not in ("VOID", kinds[fields[field]]):
            out.append((field, "type", field))
    return out


def parsed(feature_json: str = "feature_json") -> Column:
    """The sidecar as a variant; null where it doesn't parse."""
    return F.try_parse_json(F.col(feature_json))


def fingerprint(variant: Column) -> Column:
    """Canonical schema text of a variant object; null for anything but an object with fields."""
    text = F.regexp_replace(F.schema_of_variant(variant), r"DECIMAL\(\d+,\d+\)|BIGINT|DOUBLE|FLOAT", "NUMBER")
    return F.when(text.startswith("OBJECT<") & (text != "OBJECT<>"), text)


def batch_of_track(ingest_log: DataFrame) -> DataFrame:
    """(track_id, batch_id): the batch that wrote the track's sidecar."""
    written = F.col("status").isin("processed", "re-extracted") & F.col("track_id").isNotNull()
    return ingest_log.where(written).select("track_id", "batch_id").distinct()


def fingerprints(tracks: DataFrame, ingest_log: DataFrame) -> DataFrame:
    """(batch_id, fingerprint, n_sidecars): the shapes that each batch wrote."""
    shapes = tracks.select(F.col("id").alias("track_id"), parsed().alias("v")).select("track_id", fingerprint(F.col("v")).alias("fingerprint"))
    return shapes.where("fingerprint is not null").join(batch_of_track(ingest_log), "track_id").groupBy("batch_id", "fingerprint").agg(F.count_distinct("track_id").alias("n_sidecars"))


def drift_report(tracks: DataFrame, ingest_log: DataFrame, sidecar_schema: DataFrame) -> DataFrame:
    """(batch_id, field_path, drift_kind, seen_path): one row per change of a batch.

    ``sidecar_schema`` is the reference schema; it has a row per field and is read to the driver.
    """
    rows = sidecar_schema.select("field_path", "json_type", "required").distinct().collect()
    fields = {r.field_path: r.json_type for r in rows if r.field_path is not None}
    required = sorted({r.field_path for r in rows if r.field_path is not None and r.required})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[tuple[str, str, str]]] = {}
        for pdf in batches:
            out: set[tuple] = set()
            for batch, text in zip(pdf["batch_id"], pdf["fingerprint"], strict=True):
                if text not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[text] = changes(text, fields)
                out.update((batch, *c) for c in known[text])
            yield pd.DataFrame(list(out), columns=["batch_id", "field_path", "drift_kind", "seen_path"])

    shapes = fingerprints(tracks, ingest_log).select("batch_id", "fingerprint")
    seen = shapes.mapInPandas(expand, "batch_id bigint, field_path string, drift_kind string, seen_path string")
    # a batch has at most a few times as many distinct changes as there are paths
    per_batch = seen.groupBy("batch_id").agg(F.collect_set(F.struct("field_path", "drift_kind", "seen_path")).alias("c"))
    there = F.transform(F.filter("c", lambda x: x["drift_kind"].isin("present", "renamed")), lambda x: x["field_path"])
    needed = F.array(*[F.lit(f) for f in required]) if required else F.array().cast("array<string>")
    gone = F.transform(F.array_except(needed, there), lambda f: F.struct(f.alias("field_path"), F.lit("removed").alias("drift_kind"), F.lit("").alias("seen_path")))
    all_rows = per_batch.select("batch_id", F.explode(F.concat(F.filter("c", lambda x: x["drift_kind"] != "present"), gone)).alias("r"))
    return all_rows.select("batch_id", "r.field_path", "r.drift_kind", "r.seen_path")


def old_paths(field: str) -> list[str]:
    """Every path from which the chain brings a value to ``field``, its own place first."""
    found = [field]
    for step in reversed(STEPS):
        for target in list(found):
            for old, new in step.renames:
                if new.endswith("*") and target.startswith(new[:-1]):
                    found.append(old[:-1] + target[len(new) - 1 :])
                elif target == new:
                    found.append(old)
    return [p for p in dict.fromkeys(found) if migrate(p) == field]


_NUMBER = r"^\s*([-+]?(?:\d+[.,]?\d*|[.,]\d+)(?:[eE][-+]?\d+)?)"


def number(text: Column) -> Column:
    """Cast rule: the number at the start of a text, with decimal point or comma; units may follow.

    ``m:ss`` is read as seconds; commas before a point group thousands. Anything else is null.
    """
    clock = r"^\s*(\d+):([0-5]\d(?:\.\d+)?)\s*$"
    direct = text.try_cast("double")
    ungrouped = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?:,\d{3})*\.)", "")
    plain = F.replace(F.regexp_extract(ungrouped, _NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double")
    seconds = F.regexp_extract(text, clock, 1).try_cast("double") * 60 + F.regexp_extract(text, clock, 2).try_cast("double")
    # most values are numbers as they stand: patterns are tried only on the others
    return F.coalesce(F.when(F.abs(direct) < float("inf"), direct), F.when(text.rlike(clock), seconds), plain)


def field_value(variant: Column, field: str) -> Column:
    """A reference field's value, wherever and however its batch wrote it; null where it is nowhere.

    A number inside a one-element list or under ``p`` of an object is unwrapped.
    """
    at = []
    for path in old_paths(field):
        steps = "$" + "".join(f"['{p}']" for p in path.split("."))
        text = F.try_variant_get(variant, steps, "string")
        if FIELDS[field] == "string":
            plain = ~F.coalesce(F.schema_of_variant(F.try_variant_get(variant, steps, "variant")).rlike("^(OBJECT|ARRAY)<"), F.lit(False))
            at.append(F.when(plain, text))
        else:
            at += [number(text), number(F.try_variant_get(variant, steps + "[0]", "string")), number(F.try_variant_get(variant, steps + ".p", "string"))] if path == field else [number(text)]
    return F.coalesce(*at)


def unify(tracks: DataFrame, fields: list[str] | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The consistent table: ``keep`` columns and one typed column per field (dots as ``__``).

    Default rule: a field that is nowhere, or can't be cast, is null.
    """
    wanted = list(FIELDS) if fields is None else fields
    base = tracks.select(*keep, parsed().alias("__sidecar"))
    return base.select(*keep, *[field_value(F.col("__sidecar"), f).alias(f.replace(".", "__")) for f in wanted])
