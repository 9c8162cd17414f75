"""Hooks for perception steps, and the text rules by name in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tracewell.functions import text
from tracewell.operators.evaluate import aligned


def map_provider(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``fn`` makes of each batch, and a column ``failure``.

    A failing batch is tried row by row, and a row that fails comes back with its
    failure and nulls, so that one bad row never ends the job.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def attempt(frame: pd.DataFrame) -> pd.DataFrame:
        return fn(frame)[names].assign(failure=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            try:
                yield attempt(frame)
            except Exception:  # noqa: BLE001
                for i in range(len(frame)):
                    try:
                        yield attempt(frame.iloc[i : i + 1])
                    except Exception as x:  # noqa: BLE001
                        yield pd.DataFrame([{**dict.fromkeys(names), "failure": f"{type(x).__name__}: {x}"}])

    return df.mapInPandas(run, f"{schema}, failure string")


class MergeSpans:
    """``merge_spans(TABLE(spans) PARTITION BY ... ORDER BY start_us, end_us)``: the union of each partition's half-open spans.

    The argument is a table with start_us and end_us; its other columns,
    which are to be those of the partition, come back with each span. Rows stream
    through in order, one span is open at a time. Empty spans and those
    without an end are dropped, touching ones join.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("merge_spans takes a table")
        names = [f.name for f in rows.dataType.fields]
        if not {"start_us", "end_us"} <= set(names):
            raise ValueError("merge_spans needs the columns start_us and end_us")
        keys = [f for f in rows.dataType.fields if f.name not in ("start_us", "end_us")]
        return AnalyzeResult(StructType([*keys, StructField("start_us", LongType()), StructField("end_us", LongType())]))

    def __init__(self) -> None:
        self.open: list | None = None

    def eval(self, row: Row):
        start, end = row["start_us"], row["end_us"]
        if start is None or end is None or start >= end:
            return
        if self.open and start < self.open[1]:
            raise ValueError("merge_spans needs its rows ordered by start_us")
        if self.open and start <= self.open[2]:
            self.open = (self.open[0], start, max(end, self.open[2]), self.open[3])
            return
        yield from self.terminate()
        self.open = (start, start, end, [row[c] for c in row.__fields__ if c not in ("start_us", "end_us")])

    def terminate(self):
        if self.open:
            start, _, end, keys = self.open
            yield (*keys, start, end)


#: The text rules as SQL, for :func:`register_functions`: what the functions of ``functions.text`` and ``operators.visual`` build.
_NAMES = ", ".join(f"'{name}', '{n}'" for name, n in zip(text.NUMBER_NAMES, text.NUMBER_VALUES, strict=True))
SQL_FUNCTIONS = {
    "normalise_words(text STRING) RETURNS ARRAY<STRING>": rf"""transform(filter(split(regexp_replace(regexp_replace(regexp_replace(lower(text),
        r',(?<=[0-9],)(?=[0-9]{{3}}(?![0-9]))', ''), r'-(?<={text.WORD}-)(?={text.WORD})', ''), r'\.(?<![0-9]\.)|\.(?![0-9])|[^\p{{IsAlphabetic}}\p{{N}}.]+', ' '), ' +'), w -> w <> ''),
        w -> CASE WHEN rlike(w, r'^[0-9]+\.[0-9]+$') THEN regexp_replace(regexp_replace(w, '0+$', ''), r'\.$', '') ELSE coalesce(try_element_at(map({_NAMES}), w), w) END)""",
    "phrase_match(words ARRAY<STRING>, query ARRAY<STRING>) RETURNS BOOLEAN": rf"""size(query) > 0 AND rlike(array_join(words, '{text.SEP}'), concat('(^|{text.SEP})',
        array_join(transform(filter(split(array_join(query, ''), ''), c -> c <> ''), c -> IF(c = '.', r'\.', c)), '{text.SEP}?'), '({text.SEP}|$)'))""",
    "difference_hash(blocks ARRAY<INT>) RETURNS BIGINT": """aggregate(slice(transform(blocks, (x, i) -> IF((i + 1) % 8 <> 0 AND x > coalesce(get(blocks, i + 1), x), 1, 0)), 1, 64), 0L, (a, b) -> shiftleft(a, 1) | CAST(b AS BIGINT))""",
    "hash_distance(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
}


def register_functions(spark: SparkSession) -> None:
    """Functions for SQL: ``word_edits``, the table function ``merge_spans``, and those of ``SQL_FUNCTIONS``, which Spark puts into the plan as expressions."""

    @pandas_udf("substitutions long, deletions long, insertions long, words long")
    def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([aligned([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(reference, hypothesis, strict=True)], columns=["substitutions", "deletions", "insertions", "words"])

    spark.udf.register("word_edits", word_edits)
    spark.udtf.register("merge_spans", udtf(MergeSpans))
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
