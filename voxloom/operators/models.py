"""Slots for user models: a callable gets one chunk (or text) at a time, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from voxloom.operators.chunks import WORDS
from voxloom.sources.shared import bounded_batches


def apply_model(rows: DataFrame, load: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """load() runs once a task and gives the model; the model makes one output row (dict) of an input row (dict)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame([model(r) for r in batch.to_dict("records")])

    bounded_batches(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def explode_model(rows: DataFrame, load: Callable[[], Callable[[dict], list[dict]]], schema: str, columns: list[str]) -> DataFrame:
    """As apply_model, with any number of output rows for an input row (n-best lists, segments, tags)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame([o for r in batch.to_dict("records") for o in model(r)], columns=columns)

    bounded_batches(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def recognize(chunks: DataFrame, load: Callable[[], Callable[[dict], list[dict]]]) -> DataFrame:
    """(record_id, chunk_id, start_s, end_s, words): a recognizer makes a list of word dicts of a chunk."""

    def loaded() -> Callable[[dict], dict]:
        model = load()
        return lambda r: {k: r[k] for k in ("record_id", "chunk_id", "start_s", "end_s")} | {"words": model(r)}

    return apply_model(chunks, loaded, f"record_id string, chunk_id string, start_s double, end_s double, words {WORDS}")


def score_texts(rows: DataFrame, load: Callable[[], Callable[[str], float]], text_col: str = "text", out: str = "lm") -> DataFrame:
    """rows with a language model's score of each text."""

    def loaded() -> Callable[[dict], dict]:
        model = load()
        return lambda r: r | {out: float(model(r[text_col]))}

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return apply_model(rows, loaded, f"{fields}, {out} double")
