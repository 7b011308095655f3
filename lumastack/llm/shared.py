"""What several corpus operators share: the folder that all executors see, and blocks of bounded size inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumastack.sources.shared import materialise, shared_dir

__all__ = ["Interner", "doc_chunks", "fold", "gather", "intern_lists", "lower_ascii", "materialise", "shared_dir", "text_blocks", "words_of"]

#: Text that one block of a task holds at most (one longer text is a block of its own).
BLOCK_BYTES = 16 << 20


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the fold of a row."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def lower_ascii(text: Column) -> Column:
    """text with A-Z only lower-cased. lower() is the same for pure ASCII and several times as fast as translate()."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most limit bytes of text; a longer text is alone in its slice."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


class Interner(dict):
    """Numbers each new key: interner[key] is its place among the distinct keys seen."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def intern_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct items of all lists of strings, the items as places among them (flat), and where each list starts (one more at the end).

    Empty items are left out; a null list counts as empty.
    """
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts, places = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), coded.indices.to_numpy(zero_copy_only=False)
    items = coded.dictionary
    empty = pc.index(items, pa.scalar("", items.type)).as_py()
    if empty >= 0:
        keep = places != empty
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        places = places[keep]
        places = places - (places > empty)
        items = items.filter(pc.not_equal(items, ""))
    return items, places, starts


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """intern_lists of the words of each text: runs without ASCII white space."""
    return intern_lists(pc.ascii_split_whitespace(texts.cast(pa.large_string())))


def gather(values: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs values[starts[p]:starts[p + 1]] for each p of places, one after another."""
    sizes = (starts[1:] - starts[:-1])[places]
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts[places] - ends + sizes, sizes) + np.arange(ends[-1])]


def doc_chunks(doc_starts: np.ndarray, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most limit items each (or one document)."""
    n, first = len(doc_starts) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(doc_starts, doc_starts[first] + limit, side="right")) - 1)
        yield first, last
        first = last
