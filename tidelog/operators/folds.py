"""Sequential rules over the rows of a key, streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from tidelog.storage import ship


def ordered_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable[[], Any], step: Callable[..., tuple[Any, tuple | None]], schema: str) -> DataFrame:
    """Fold each key's rows in order: step(state, *columns) -> (state, output or None); outputs follow their key in `schema`.

    Partitions are sorted by key and order and read in batches, so a task holds one state and one batch, whatever the
    size of a key: rows of a key are never gathered.
    """
    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    n = len(keys)
    cols = [*keys, *columns]

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        state = None
        for pdf in parts:
            out = []
            for row in zip(*[pdf[c].tolist() for c in cols]):
                if row[:n] != at:
                    at, state = row[:n], start()
                state, got = step(state, *row[n:])
                if got is not None:
                    out.append((*at, *got))
            yield pd.DataFrame(out, columns=names)

    return rows.select(*dict.fromkeys([*cols, *order])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(of, schema)
