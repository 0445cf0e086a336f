"""Names for steps, decoders, metrics, sources and predictors: an explicit list in place of evaluated names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from quire.functions.sequences import ENCODERS, Decoder


class Registry:
    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str, value=None):
        """Adds a value under a name; as a decorator without one. A name is given once."""
        def add(v):
            if name in self.known:
                raise ValueError(f"{self.kind} {name!r} is there already")
            self.known[name] = v
            return v

        return add if value is None else add(value)

    def get(self, name: str):
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]


OPS, DECODERS, METRICS, SOURCES = Registry("step"), Registry("decoder"), Registry("metric"), Registry("source")
for _name in ("attention", "spin"):
    DECODERS.register(_name, Decoder(skip=(ENCODERS[_name].number("sos"), ENCODERS[_name].number("eos"))))
DECODERS.register("ctc", Decoder(skip=(0,), repeats=True, empty=0.0))
DECODERS.register("abinet", Decoder(stop=(0,)))
DECODERS.register("pren", Decoder(skip=(0, 2), stop=(1,), empty=1.0))


def chain(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Applies registered steps in order."""
    for name, options in steps:
        df = df.transform(OPS.get(name), **options)
    return df


def merged(base: dict, over: dict) -> dict:
    """over laid on base at every depth; None means not set; dotted names are paths."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for key, value in over.items():
        first, _, rest = key.partition(".")
        value = {rest: value} if rest else value
        if value is None:
            continue
        out[first] = merged(out.get(first) if isinstance(out.get(first), dict) else {}, value) if isinstance(value, dict) else value
    return out


class Predictor(Protocol):
    def predict(self, frame: pd.DataFrame) -> pd.DataFrame: ...


def predict(df: DataFrame, make: Callable[[], Predictor], schema: str) -> DataFrame:
    """Rows through a model, a batch at a time; the model is made once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield model.predict(frame)

    return df.mapInPandas(run, schema)
