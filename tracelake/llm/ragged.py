"""Lists of ids kept end to end in one array, and batches cut to a bounded number of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters whose words are in memory at once, unless a single text has more.
SLICE_CHARS = 750_000


def sliced(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch in slices of about SLICE_CHARS characters of text, at least one row each."""
    part = (batch["text"].str.len().to_numpy(dtype=np.int64).cumsum() - 1).clip(0) // SLICE_CHARS
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def give_back() -> None:
    """At a task's end: workers live on, and what Arrow keeps for them is no one else's."""
    pa.default_memory_pool().release_unused()


def row_by_row(rows: DataFrame, carried: list[str], opened: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], made: str) -> DataFrame:
    """The carried columns of each row with the columns `made` of it, by a function that each task opens and that gets the other columns.

    The carried columns never leave Arrow: pandas would make doubles of identifiers beside a null one, and change those above 2^53.
    """
    kept = rows.select(*carried).schema
    schema = StructType([*kept.fields, *StructType.fromDDL(made).fields])
    whole = to_arrow_schema(schema)
    new = pa.schema([whole.field(k) for k in range(len(carried), len(whole))])

    def run(batches):
        each = opened()
        for batch in batches:
            frame = batch.select([n for n in batch.schema.names if n not in carried]).to_pandas()
            at = 0
            for part in sliced(frame):
                out = pa.RecordBatch.from_pandas(each(part), schema=new, preserve_index=False)
                ids = [batch.column(n).slice(at, len(part)).cast(whole.field(n).type) for n in carried]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*ids, *out.columns], schema=whole)
        give_back()

    return rows.mapInArrow(run, schema)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of `flat` at starts, end to end."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class Lists:
    """Words and their ids; forgets all of them when it holds more than `most`."""

    def __init__(self, most: int = 300_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[object, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)

    def add(self, words: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.rows), len(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + k > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + k] = lengths
        self.used += len(flat)
        self.rows.update(zip(words, range(n, n + k), strict=True))


class Recent(Lists):
    """Words and their ids; each time that it holds more than `most`, it forgets those not asked for since the time before."""

    def clear(self) -> None:
        super().clear()
        self.former = None

    def missing(self, words: list) -> list:
        """Those of different words that are not remembered. Rows found before this call are no longer valid."""
        if len(self.rows) > self.most:
            former = copy(self)
            self.clear()
            self.former, former.former = former, None
        words = [x for x in words if x not in self.rows]
        if self.former is None:
            return words
        old = self.former.rows
        back = [x for x in words if x in old]
        at = np.fromiter((old[x] for x in back), np.int64, len(back))
        lengths = self.former.lengths[at]
        self.add(back, gathered(self.former.flat, self.former.starts[at], lengths), lengths)
        return [x for x in words if x not in old]

    def at(self, words: list) -> np.ndarray:
        """Rows of remembered words."""
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
