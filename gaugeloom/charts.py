"""Charts of small results, where matplotlib is installed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom.runtime import bounded


def _axes(width: float = 8, height: float = 5):
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("charts need matplotlib") from e
    return plt.subplots(figsize=(width, height))


def bar_rows(df: DataFrame, name: str, value: str, low: str | None = None, high: str | None = None, limit: int = 200) -> list[tuple]:
    """(name, value, distance below, distance above) by falling value: what a bar chart draws; more than ``limit`` are an error."""
    rows = bounded(df.where(F.col(value).isNotNull()).orderBy(F.desc(value), name), limit)
    return [(r[name], r[value], r[value] - r[low] if low else 0.0, r[high] - r[value] if high else 0.0) for r in rows]


def heat_rows(df: DataFrame, row: str, col: str, value: str, columns: list[str], limit: int = 200) -> tuple[list, list[list[float]]]:
    """Row names and a dense matrix, absent cells NaN: what a heat map draws; more than ``limit`` rows are an error."""
    rows = bounded(df.groupBy(row).pivot(col, columns).agg(F.first(value)).orderBy(row), limit)
    return [r[row] for r in rows], [[float("nan") if r[c] is None else float(r[c]) for c in columns] for r in rows]


def bars(df: DataFrame, name: str, value: str, path: str, **limits) -> None:
    rows = bar_rows(df, name, value, **limits)
    fig, ax = _axes()
    ax.bar([str(r[0]) for r in rows], [r[1] for r in rows], yerr=[[r[2] for r in rows], [r[3] for r in rows]])
    ax.set_ylabel(value)
    ax.tick_params(axis="x", rotation=60)
    fig.savefig(path, bbox_inches="tight", dpi=150)


def heat_map(df: DataFrame, row: str, col: str, value: str, columns: list[str], path: str) -> None:
    names, cells = heat_rows(df, row, col, value, columns)
    fig, ax = _axes(1 + len(columns), 1 + 0.5 * len(names))
    ax.imshow(cells, aspect="auto")
    ax.set_xticks(range(len(columns)), columns)
    ax.set_yticks(range(len(names)), names)
    fig.savefig(path, bbox_inches="tight", dpi=150)


def grouped_rows(df: DataFrame, group: str, name: str, value: str, limit: int = 200) -> tuple[list, dict[str, list[float]]]:
    """Group names and, per name, a value for each of them, absent ones NaN: what grouped bars and lines draw. Groups that are whole numbers are ordered as numbers."""
    rows = bounded(df.groupBy(group, name).agg(F.first(value).alias("v")), limit * limit)
    whole = all(str(r[group]).lstrip("-").isdigit() for r in rows if r[group] is not None)
    groups = sorted({r[group] for r in rows if r[group] is not None}, key=lambda g: (int(g),) if whole else (str(g),))
    names = sorted({r[name] for r in rows if r[name] is not None})
    known = {(r[group], r[name]): r["v"] for r in rows}
    return groups, {n: [float("nan") if known.get((g, n)) is None else float(known[g, n]) for g in groups] for n in names}


def radar_rows(df: DataFrame, name: str, metrics: list[str], limit: int = 200) -> tuple[list[float], dict[str, list[float]]]:
    """Angles and closed outlines per name: what a radar draws. Fewer than three metrics are an error; missing values are 0."""
    if len(metrics) < 3:
        raise ValueError("a radar needs three metrics or more")
    angles = [2 * math.pi * k / len(metrics) for k in range(len(metrics))]
    rows = bounded(df.select(name, *metrics).orderBy(name), limit)
    return [*angles, angles[0]], {r[name]: [*(float(r[m] or 0.0) for m in metrics), float(r[metrics[0]] or 0.0)] for r in rows}


def grouped_bars(df: DataFrame, group: str, name: str, value: str, path: str) -> None:
    groups, series = grouped_rows(df, group, name, value)
    fig, ax = _axes()
    width = 0.8 / max(1, len(series))
    for k, (n, values) in enumerate(series.items()):
        ax.bar([i + k * width for i in range(len(groups))], values, width, label=str(n))
    ax.set_xticks([i + 0.4 - width / 2 for i in range(len(groups))], [str(g) for g in groups])
    ax.legend()
    fig.savefig(path, bbox_inches="tight", dpi=150)


def lines(df: DataFrame, x: str, name: str, value: str, path: str) -> None:
    groups, series = grouped_rows(df, x, name, value)
    fig, ax = _axes()
    for n, values in series.items():
        ax.plot([str(g) for g in groups], values, marker="o", label=str(n))
    ax.legend()
    fig.savefig(path, bbox_inches="tight", dpi=150)


def radar(df: DataFrame, name: str, metrics: list[str], path: str) -> None:
    angles, outlines = radar_rows(df, name, metrics)
    fig, ax = _axes(6, 6)
    ax.remove()
    ax = fig.add_subplot(projection="polar")
    for n, values in outlines.items():
        ax.plot(angles, values, label=str(n))
    ax.set_xticks(angles[:-1], metrics)
    ax.legend()
    fig.savefig(path, bbox_inches="tight", dpi=150)


def bundle(df: DataFrame, name: str, metrics: list[str], folder: str) -> list[str]:
    """One bar chart per metric, and a radar where there are three or more; the paths written."""
    paths = []
    for m in metrics:
        paths.append(f"{folder}/{m}.png")
        bars(df, name, m, paths[-1])
    if len(metrics) >= 3:
        paths.append(f"{folder}/radar.png")
        radar(df, name, metrics, paths[-1])
    return paths
