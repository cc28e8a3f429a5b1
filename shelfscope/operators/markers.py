"""Many markers sought in texts at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(8)
def _automaton(sought: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for m in sought:
        automaton.add_word(m, m)
    automaton.make_automaton()
    return automaton


def markers_found(fields: dict[str, Column], markers: list[str]) -> Column:
    """What markers stand in which of the named texts, in lower case, as field:marker; one pass over a text, within its row."""
    sought = tuple(sorted({m.lower() for m in markers}))
    names = list(fields)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def find(*columns: pa.Array) -> pa.Array:
        automaton = _automaton(sought)
        lists = []
        for texts in zip(*[c.to_pylist() for c in columns], strict=True):
            lists.append([f"{name}:{m}" for name, text in zip(names, texts, strict=True) if text for m in sorted({m for _, m in automaton.iter(text.lower())})])
        return pa.array(lists, pa.list_(pa.string()))

    return find(*fields.values())


def marker_counts(rows: DataFrame, keys: list[str], fields: list[str], markers: list[str]) -> DataFrame:
    """keys, field, marker, times: how often each marker stands in each of the text columns, in lower case.

    One Aho-Corasick automaton finds all markers in one pass over a text, however many they are;
    places that overlap count.  Null and empty texts have none.  Rows stay where they are.
    """
    sought = sorted({m.lower() for m in markers})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tuple(sought))
        for batch in batches:
            at, where, what, times = [], [], [], []
            for field in fields:
                for i, text in enumerate(batch.column(field)):
                    text = text.as_py()
                    if text and sought:
                        for marker, n in sorted(Counter(m for _, m in automaton.iter(text.lower())).items()):
                            at.append(i)
                            where.append(field)
                            what.append(marker)
                            times.append(n)
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(where, pa.string()), pa.array(what, pa.string()), pa.array(times, pa.int64())], [*keys, "field", "marker", "times"])

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("field", T.StringType()), T.StructField("marker", T.StringType()), T.StructField("times", T.LongType())])
    return rows.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).mapInArrow(find, schema)
