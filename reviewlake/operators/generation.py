"""A pluggable batch text-generation stage (E1-E3): prompts in, completions out, parsing by expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

# Default sampling parameters.
SAMPLING = {"temperature": 0.7, "top_p": 0.8, "top_k": 20, "min_p": 0.0}


class CompletionBackend(Protocol):
    """Anything that completes a batch of prompts, n times each."""

    def complete(self, prompts: list[str], n: int, sampling: dict) -> list[list[str]]: ...


class StubBackend:
    """Deterministic completions for tests and dry runs: the prompt's length and first word as JSON."""

    def complete(self, prompts: list[str], n: int, sampling: dict) -> list[list[str]]:
        return [[f'Here: {{"summary": "{(p.split() or [""])[0]}", "length": {len(p)}, "pick": {i}}}' for i in range(n)] for p in prompts]


def generate(prompts: DataFrame, backend: Callable[[], CompletionBackend], column: str = "prompt", n: int = 1, sampling: dict | None = None) -> DataFrame:
    """prompts with a column completions. backend is called once a task, as models load there. Null prompts get no completions."""
    merged = {**SAMPLING, **(sampling or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or backend()
            ask = pdf[column].notna()
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            if ask.any():
                out[ask] = pd.Series(model.complete(pdf.loc[ask, column].tolist(), n, merged), index=pdf.index[ask])
            yield pdf.assign(completions=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{fields}, completions array<string>")
