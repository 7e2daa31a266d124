"""Validation of many documents at once: the rules for one document, run over a column of JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def judged(rows: DataFrame, document: str, rule: Callable[[Mapping[str, Any]], Any], out: str = "problem") -> DataFrame:
    """``rows`` with the problem that ``rule`` finds in each document, null where it accepts it.

    A document is an object in JSON; text that isn't one is a problem, too. Rows are
    judged where they are: nothing is shuffled.
    """

    def problem(text: str | None) -> str | None:
        try:
            found = json.loads(text or "")
            if not isinstance(found, dict):
                return "not an object"
            rule(found)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return f"{type(e).__name__}: {e}"
        return None

    return mapped(rows, document, problem, out)


def mapped(rows: DataFrame, column: str, of: Callable[[str | None], str | None], out: str) -> DataFrame:
    """``rows`` with a text made of the text in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(v) for v in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
