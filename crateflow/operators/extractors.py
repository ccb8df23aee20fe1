"""Extractors in phases, with time limits and a guard around each file.

A partition loads its tools once. Tags, signal features and mood come one after the other: a file whose
mood fails keeps its signal features and has no mood, so that it can be tried again; a file whose other
phases fail is an error row, and the files after it go on.
"""

from __future__ import annotations

import json
import os
import signal
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pandas as pd

from crateflow.functions.columns import SCHEMA_HASH

#: Per phase, the variable that sets its limit and the seconds without it.
LIMITS = {"all": ("EXTRACT_TIMEOUT_SEC", 180), "dsp": ("EXTRACT_DSP_TIMEOUT_SEC", 60), "mood": ("EXTRACT_MOOD_TIMEOUT_SEC", 180)}
COLUMNS = ["file_path", "title", "artist", "duration_sec", "feature_json", "clap_embedding", "error"]


def limit_of(phase: str, given: int | None = None, overall: int | None = None) -> int:
    """Seconds of a phase: the overall limit if given, else its own, else the environment's, else the default.

    An environment value that is blank or no number is ignored.
    """
    if phase not in LIMITS:
        raise ValueError(f"unknown phase {phase!r}")
    for wanted in (overall, given):
        if wanted is not None:
            return int(wanted)
    variable, default = LIMITS[phase]
    try:
        return int(os.environ.get(variable, "").strip())
    except ValueError:
        return default


@contextmanager
def within(seconds: float):
    """Raises TimeoutError in the block after so many seconds; only the main thread can be interrupted."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"no result within {seconds:g} s")

    old = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


@dataclass(frozen=True)
class Tools:
    """What a partition loads once: each takes a path. ``mood`` and ``embedding`` may be missing."""

    tags: Callable[[str], tuple[str | None, str | None]]
    features: Callable[[str], dict[str, Any]]
    mood: Callable[[str], dict[str, Any]] | None = None
    embedding: Callable[[str], list[float]] | None = None


@dataclass(frozen=True)
class Limits:
    overall: int | None = None
    dsp: int | None = None
    mood: int | None = None


def phased(load: Callable[[], Tools], limits: Limits = Limits(), no_mood: bool = False):
    """An ingest extractor out of tools."""
    dsp, mood, whole = limit_of("dsp", limits.dsp, limits.overall), limit_of("mood", limits.mood, limits.overall), limit_of("all", limits.overall)

    def one(tools: Tools, path: str, action: str, needs_embedding: bool) -> dict[str, Any]:
        row: dict[str, Any] = dict.fromkeys(COLUMNS) | {"file_path": path}
        if action != "skip":
            with within(dsp):
                row["title"], row["artist"] = tools.tags(path)
                sidecar = dict(tools.features(path))
            sidecar["schema_hash"] = SCHEMA_HASH
            row["duration_sec"] = float(sidecar.get("duration_sec") or 0.0)
            if tools.mood and not no_mood:
                try:
                    with within(mood):
                        sidecar["mood"] = tools.mood(path)
                except Exception:
                    sidecar.pop("mood", None)
            row["feature_json"] = json.dumps(sidecar)
        if needs_embedding and tools.embedding:
            try:
                with within(whole):
                    row["clap_embedding"] = [float(x) for x in tools.embedding(path)]
            except Exception as e:
                row["error"] = f"{type(e).__name__}: {e}"
        return row

    def extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = None
        for pdf in batches:
            rows = []
            for path, action, needs in zip(pdf["file_path"], pdf["action"], pdf["needs_embedding"], strict=True):
                try:
                    tools = tools or load()
                    rows.append(one(tools, path, action, bool(needs)))
                except Exception as e:
                    rows.append(dict.fromkeys(COLUMNS) | {"file_path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=COLUMNS)

    return extractor


def command(program: list[str], seconds: int, *options: str) -> Callable[[str], dict[str, Any]]:
    """A tool that runs ``program <audio> <output.json> options`` for each file and reads the JSON it writes.

    A status other than 0, an end of the time, or no output is an error.
    """

    def run(path: str) -> dict[str, Any]:
        with tempfile.TemporaryDirectory() as folder:
            out = Path(folder) / "sidecar.json"
            done = subprocess.run([*program, path, str(out), *options], timeout=seconds, capture_output=True, text=True, check=False)
            if done.returncode:
                raise RuntimeError(done.stderr.strip()[-500:] or f"status {done.returncode}")
            if not out.exists():
                raise RuntimeError("no output was written")
            return json.loads(out.read_text(encoding="utf-8"))

    return run


def manifest_summary(manifest, extracted):
    """(ok, failed) of a batch manifest (audio_path, output_path) against extracted rows: arrays, failed ones with their error."""
    from pyspark.sql import functions as F

    joined = manifest.join(extracted.select(F.col("file_path").alias("audio_path"), "error", F.lit(True).alias("done")), "audio_path", "left")
    error = F.when(F.col("done").isNull(), F.lit("not extracted")).otherwise(F.col("error"))
    return joined.select("output_path", error.alias("error"), error.isNull().alias("ok"))
