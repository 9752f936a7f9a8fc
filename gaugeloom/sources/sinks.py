"""Writers of results. Spark's output commit makes every write all or nothing."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from gaugeloom.runtime import bounded, copy, write_text


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV with a fixed header; missing values are empty. For reports, which are small."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def document(payload: dict | list, path: str) -> None:
    """A small JSON document, written beside its place and then moved there."""
    write_text(path, json.dumps(payload, indent=2, ensure_ascii=False, default=str))


def yaml_document(payload: dict | list, path: str) -> None:
    """A small YAML document, where PyYAML is installed."""
    import yaml

    write_text(path, yaml.safe_dump(payload, allow_unicode=True, sort_keys=False))


def mirror(source: str, target: str) -> None:
    """A result copied to a second place."""
    copy(source, target)


def metrics_bundle(path: str, summary: DataFrame, items: DataFrame, groups: DataFrame, limit: int = 10_000) -> None:
    """summary (at most ``limit`` rows, else an error) as a JSON document naming two sidecars: items without counts, and groups, as JSON lines."""
    json_lines(items.drop("tp", "fp", "fn"), f"{path}.items")
    json_lines(groups, f"{path}.groups")
    rows = [r.asDict(recursive=True) for r in bounded(summary, limit)]
    document({"metrics": rows, "artifacts": {"per_item_jsonl": f"{Path(path).name}.items", "per_group_json": f"{Path(path).name}.groups"}}, f"{path}.metrics.json")


def manifest(path: str, benchmark: str, model: str, config: dict, stats: dict, files: list[str]) -> None:
    document({"benchmark": benchmark, "model": model, "config": config, "stats": stats, "files": files}, path)


def text(path: str, content: str) -> None:
    write_text(path, content)
