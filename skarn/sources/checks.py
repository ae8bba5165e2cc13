"""Checks of input files before a run: they read column names, a few sample rows and, where asked for, counts.

A check gives findings, in order; it fails if any of them does. Nothing is written and no rows are made up.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import label_in_text
from skarn.sources import contracts as C
from skarn.sources.contracts import ContractError, resolve_aliases, window_columns
from skarn.sources.readers import detect_format, exists, inspect

Aliases = Mapping[str, tuple[str, ...]]


@dataclass
class Findings:
    """(level, message) in order; level is pass, warn, fail or info."""

    rows: list[tuple[str, str]] = field(default_factory=list)

    def add(self, level: str, message: str) -> None:
        self.rows.append((level, message))

    @property
    def passed(self) -> bool:
        return all(level != "fail" for level, _ in self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], "step int, level string, message string")


def _columns(spark: SparkSession, f: Findings, what: str, path: str | None, aliases: Aliases, required: bool, samples: int) -> tuple[list[str], dict[str, str]] | None:
    """(columns, canonical -> column) of a file; None, with a finding, if it is absent or lacks a column."""
    if path is None or not exists(spark, path):
        f.add("fail" if required else "warn", f"{what}: {'required' if required else 'optional'} file missing: {path}")
        return None
    seen = inspect(spark, path, samples)
    f.add("info", f"{what}: {seen['format']}, delimiter {seen['delimiter']!r}, columns {', '.join(seen['columns'])}; {len(seen['samples'])} sample rows")
    found, missing = resolve_aliases(seen["columns"], aliases)
    if missing:
        f.add("fail", f"{what}: missing columns {', '.join(missing)}")
        return None
    f.add("pass", f"{what}: " + ", ".join(f"{k} <- {v}" for k, v in found.items()))
    return seen["columns"], found


def check_market_data(spark: SparkSession, daily: str, link: str | None = None, benchmark: str | None = None, header: str | None = None, samples: int = 3) -> Findings:
    """Daily returns are required; so is the link table, unless the daily file names its securities; benchmark and stock header are optional."""
    f = Findings()
    got = _columns(spark, f, "daily returns", daily, C.DAILY_ALIASES, True, samples)
    _columns(spark, f, "benchmark returns", benchmark, C.BENCHMARK_ALIASES, False, samples)
    _columns(spark, f, "stock header", header, C.HEADER_ALIASES, False, samples)
    names = resolve_aliases(got[0], C.DAILY_IDENTIFIERS)[0] if got else {}
    f.add("pass" if names else "warn", f"daily returns: identifiers to fall back on: {', '.join(names) or 'none'}")
    trial = Findings()
    linked = _columns(spark, trial, "link table", link, C.LINK_ALIASES, True, samples)
    f.rows += [("warn" if level == "fail" and names else level, m) for level, m in trial.rows]
    if not linked and names:
        f.add("warn", "without the link table events can be matched by fallback identifiers only")
    return f


def check_event_panel(spark: SparkSession, events: str, daily: str, link: str | None = None, header: str | None = None, benchmark: str | None = None, samples: int = 3) -> tuple[Findings, list[str]]:
    """(findings, join steps in order of preference) for matching events with securities; no steps if the check fails."""
    f = Findings()
    ev = _columns(spark, f, "events", events, C.EVENT_ALIASES, True, samples)
    ids = resolve_aliases(ev[0], C.EVENT_IDENTIFIERS)[0] if ev else {}
    if ev:
        best = next((k for k in ("gvkey", "cusip", "ticker") if k in ids), None)
        notes = {"gvkey": ("pass", "joins by gvkey"), "cusip": ("warn", "no gvkey; cusip only"), "ticker": ("warn", "ticker only: for diagnosis"), None: ("fail", "no identifier among gvkey, cusip, ticker")}
        f.add(notes[best][0], f"events: {notes[best][1]}")
    got = _columns(spark, f, "daily returns", daily, C.DAILY_ALIASES, True, samples)
    fallback = resolve_aliases(got[0], C.DAILY_IDENTIFIERS)[0] if got else {}
    linked = None
    if link is not None and exists(spark, link):
        linked = _columns(spark, f, "link table", link, C.LINK_ALIASES, True, samples)
    elif not fallback:
        f.add("fail", "no link table, and the daily file has no identifiers to fall back on")
    elif not {"cusip", "ticker"} & ids.keys():
        f.add("fail", "matching without the link table needs a cusip or ticker of the events")
    else:
        f.add("warn", "no link table: fallback identifiers only")
    headed = _columns(spark, f, "stock header", header, C.HEADER_ALIASES, False, samples) if header is not None else None
    if benchmark is not None and not exists(spark, benchmark):
        f.add("warn", f"benchmark returns: optional file missing: {benchmark}")
    steps = []
    if linked and "gvkey" in ids:
        steps += ["gvkey -> permno through the link table, where event_date lies in [linkdt, linkenddt]"]
    if fallback.keys() & {"cusip", "ncusip"} and "cusip" in ids:
        steps += ["cusip -> " + " or ".join(sorted(fallback.keys() & {"cusip", "ncusip"})) + " of the daily file around event_date"]
    if "ticker" in fallback and "ticker" in ids:
        steps += ["ticker -> ticker of the daily file around event_date"]
    if headed:
        steps += ["cusip or ticker -> permno through the dated stock header"]
    return f, steps if f.passed else []


def check_event_windows(spark: SparkSession, panel: str, daily: str, windows: Iterable[str], benchmark: str | None = None, samples: int = 3) -> tuple[Findings, list[str]]:
    """(findings, columns a run would add) for windows of returns around the events of a panel; no columns if the check fails."""
    f = Findings()
    try:
        columns = window_columns(windows)
    except ValueError as e:
        f.add("fail", str(e))
        columns = []
    _columns(spark, f, "event panel", panel, C.PANEL_ALIASES, True, samples)
    _columns(spark, f, "daily returns", daily, C.DAILY_ALIASES, True, samples)
    if benchmark is not None:
        _columns(spark, f, "benchmark returns", benchmark, C.BENCHMARK_ALIASES, True, samples)
    else:
        f.add("warn", "no benchmark: benchmark and abnormal returns would be null")
    return f, columns if f.passed else []


def check_label_alignment(spark: SparkSession, windows_file: str, labels: Iterable[str], windows: Iterable[str], samples: int = 3) -> tuple[Findings, list[tuple[str, str]]]:
    """(findings, (label column, return column) pairs a report would have); at least one label column must be there."""
    f = Findings()
    labels = list(labels)
    try:
        wanted = window_columns(windows)
    except ValueError as e:
        f.add("fail", str(e))
        return f, []
    got = _columns(spark, f, "event windows", windows_file, C.WINDOW_TABLE_ALIASES, True, samples)
    if got is None:
        return f, []
    have = {c.lower() for c in got[0]}
    if gone := [c for c in wanted if c.lower() not in have]:
        f.add("fail", f"event windows: missing return columns {', '.join(gone)}")
    there = [c for c in labels if c.lower() in have]
    for c in labels:
        if c not in there:
            f.add("warn", f"event windows: label column {c} is absent")
    if not there:
        f.add("fail", "event windows: no label column")
    return f, [(c, r) for c in there for r in wanted if r.startswith("abnormal_return")] if f.passed else []


def label_words(df: DataFrame, column: str) -> DataFrame:
    """label, n: what a label column holds, reduced to its label word."""
    return df.groupBy(F.coalesce(label_in_text(F.col(column)), F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["ContractError", "Findings", "check_event_panel", "check_event_windows", "check_label_alignment", "check_market_data", "detect_format", "label_words"]
