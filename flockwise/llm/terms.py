"""How often every term occurs, and in how many records, by last-seen counters.

Each task walks its records one after another. A term's entry holds its occurrences, its records and the last
record that had it: a record is counted when it differs from the last one, so no set of terms per record is built.
A record lies in one task, hence the entries of different tasks add up exactly; they are added by hashed term, a
task sending one row per term however frequent it is. A task whose table reaches `max_terms` hands it on between
two records and starts anew, so memory stays bounded for any vocabulary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Terms a task holds before it hands its counters on; about 200 bytes each.
MAX_TERMS = 500_000
_COUNTS = "term string, occurrences long, records long"


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of letters, marks and digits after NFKC and then lower-casing; none for null or empty text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return TERM.findall(text.lower())


def _counters(max_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        record = 0

        def handed_on() -> pa.RecordBatch:
            held = list(counts.values())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in held], pa.int64()), pa.array([c[1] for c in held], pa.int64())],
                names=["term", "occurrences", "records"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                record += 1
                for term in terms_of(text):
                    c = counts.get(term)
                    if c is None:
                        counts[term] = [1, 1, record]
                    else:
                        c[0] += 1
                        if c[2] != record:
                            c[1] += 1
                            c[2] = record
                if len(counts) >= max_terms:
                    yield handed_on()
                    counts.clear()
        if counts:
            yield handed_on()

    return run


def term_counts(records: DataFrame, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, occurrences, records) over all rows of `records`; a row is one record. Null texts have no terms."""
    partial = records.select(F.col(text).alias("_t")).where(F.length("_t") > 0).mapInArrow(_counters(max_terms), _COUNTS)
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: DataFrame, rare: int, common: float) -> DataFrame:
    """`counts` with `mark`: 'rare' up to `rare` records, 'common' beyond the share `common` of `total`, else null.

    `total` is a table of one number. A term that is both (a tiny collection) is 'rare'.
    """
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * total.scalar(), "common")
    return counts.withColumn("mark", mark)
