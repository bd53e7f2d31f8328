"""Folds over many small groups: rows are dealt and sorted by their keys, and each Arrow batch holds many groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _joined(parts: list) -> np.ndarray | list:
    return np.concatenate(parts) if all(isinstance(p, np.ndarray) for p in parts) else [x for p in parts for x in p]


def _differs(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; nulls are one value."""
    empty = pd.isna(values)
    return ~((values[1:] == values[:-1]) | (empty[1:] & empty[:-1]))


def fold_groups(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fold: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """``fold(key, columns)`` over the rows of each group in order; ``columns`` are arrays by name, what comes back are equally long lists or arrays in the order of ``schema``.

    ``applyInPandas`` hands over and takes back every group by itself, which costs milliseconds each; here a group is a slice of its
    batch, and only one that goes on in the next batch is kept until it is whole."""
    dealt = (rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def folded(pdf: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        parts = [fold(tuple(columns[k][a] for k in keys), {c: v[a:b] for c, v in columns.items()}) for a, b in zip(bounds, bounds[1:])]
        out = pd.DataFrame({n: _joined([p[i] for p in parts]) for i, n in enumerate(names)}, columns=names)
        if len(out):  # a frame without rows has no types of its own
            yield out

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                last, first = held[-1].iloc[-1], pdf.iloc[0]
                if all(_differs(np.array([last[k], first[k]]))[0] == 0 for k in keys) and not any(_differs(pdf[k].to_numpy()).any() for k in keys):
                    held.append(pdf)
                    continue
                pdf = pd.concat([*held, pdf], ignore_index=True)
            changed = np.logical_or.reduce([_differs(pdf[k].to_numpy()) for k in keys])
            bounds = np.concatenate([[0], np.flatnonzero(changed) + 1])
            held = [pdf.iloc[bounds[-1] :]]
            if len(bounds) > 1:
                yield from folded(pdf.iloc[: bounds[-1]], bounds)
        if held:
            pdf = pd.concat(held, ignore_index=True)
            yield from folded(pdf, np.array([0, len(pdf)]))

    return dealt.mapInPandas(step, schema)
