"""What several operators share: words, batches, process-wide caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; ``bytes.lower`` leaves other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bucket(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % n


def process_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("_weftgraph_cache", types.ModuleType("_weftgraph_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def groups(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches of at most so many characters, or one row, with their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, total = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and total + n > most_chars:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += n
        if len(lengths) > start:
            yield batch.slice(start), column.slice(start).to_pylist()
