"""Model calls over tables: prompts as expressions, recorded answers, and a batched call in the workers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; impossible ones are an error at once."""

    model: str
    temperature: float = 0.0
    max_tokens: int = 1024
    batch: int = 16
    retries: int = 3
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.model or self.temperature < 0 or self.max_tokens < 1 or self.batch < 1 or self.retries < 0:
            raise ValueError(f"invalid run settings: {self}")


def option_prompt(text: Column, options: Column, single: bool) -> Column:
    """Question, lettered options, and what to answer with."""
    listed = F.array_join(F.transform(options, lambda o: F.concat(o["option_id"], F.lit(": "), F.coalesce(o["path"], F.lit("")))), "\n")
    ask = "Answer with one option letter" if single else "Answer with the letters of all fitting options, or none"
    return F.concat_ws("\n", text, listed, F.lit(ask + ' as JSON: {"choices": [...]}'))


def evidence_prompt(prompt: Column, task: Column) -> Column:
    ask = F.when(task == "recognition", F.lit('Answer as JSON: {"answer": "a|b|c|d"}')).otherwise(F.lit('Answer as JSON: {"labels": [...]}'))
    return F.concat_ws("\n", prompt, ask)


def prefill(task: Column) -> Column:
    return F.when(task == "recognition", '{"answer": "').otherwise('{"labels": [')


def choices_schema(allowed: list[str], most: int | None = None) -> dict:
    """JSON schema of an answer that lists distinct allowed options."""
    listed = {"type": "array", "items": {"type": "string", "enum": list(allowed)}, "uniqueItems": True}
    if most is not None:
        listed["maxItems"] = most
    return {"type": "object", "properties": {"choices": listed}, "required": ["choices"], "additionalProperties": False}


def evidence_schema(task: str, labels: list[str]) -> dict:
    if task == "recognition":
        return {"type": "object", "properties": {"answer": {"type": "string", "enum": list("abcd")}}, "required": ["answer"]}
    return {"type": "object", "properties": {"labels": {"type": "array", "items": {"type": "string", "enum": list(labels)}}}, "required": ["labels"]}


def recorded(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the answers recorded for them; success is false where there is none."""
    known = responses.dropDuplicates(keys).withColumn("_hit", F.lit(True))
    return requests.join(known, keys, "left").withColumn("success", F.coalesce("_hit", F.lit(False))).drop("_hit")


def call_model(requests: DataFrame, model: Callable[[list[str]], list[str]], config: RunConfig, id_column: str, prompt: str, wait: float = 0.5) -> DataFrame:
    """(id, raw_text, success, error, latency_ms): a batched call per Arrow batch, order kept.

    A failing batch is tried again with growing waits, then request by request; what still
    fails is a row with its error. The number of partitions bounds the calls at a time.
    """
    kind = requests.schema[id_column].dataType.simpleString()

    def answer(texts: list[str]) -> list[tuple]:
        for k in range(config.retries + 1):
            start = time.time()
            try:
                got = model(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers to {len(texts)} requests")
                ms = int((time.time() - start) * 1000 / len(texts))
                return [(g, True, None, ms) for g in got]
            except Exception as e:
                last = str(e)
                if k < config.retries:
                    time.sleep(wait * 2**k)
        return [(None, False, last, None)] if len(texts) == 1 else [r for t in texts for r in answer([t])]

    def run(frames):
        for pdf in frames:
            rows = []
            for i in range(0, len(pdf), config.batch):
                part = pdf.iloc[i : i + config.batch]
                rows += [(k, *a) for k, a in zip(part[id_column], answer(list(part[prompt])))]
            yield pd.DataFrame(rows, columns=[id_column, "raw_text", "success", "error", "latency_ms"])

    return requests.select(id_column, prompt).mapInPandas(run, f"{id_column} {kind}, raw_text string, success boolean, error string, latency_ms int")


def stages(run: bool | None, score: bool | None, other_is_opposite: bool = True) -> tuple[bool, bool]:
    """(inference, metrics) from two optional flags: none given means both; one given makes the other its opposite, or false."""
    if run is None and score is None:
        return True, True
    if run is None:
        return (not score if other_is_opposite else False), bool(score)
    if score is None:
        return bool(run), (not run if other_is_opposite else False)
    return run, score


def registry(models: DataFrame, backend: str | None = None, family: str | None = None) -> DataFrame:
    """Registered models (name, backend, family, ...) of a back end or family, by name."""
    if backend:
        models = models.where(F.col("backend") == backend)
    if family:
        models = models.where(F.col("family") == family)
    return models.orderBy("name")


def registered(models: DataFrame, name: str) -> dict:
    """One model's settings; an unknown name is an error."""
    row = models.where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"unknown model: {name}")
    return row.asDict(recursive=True)
