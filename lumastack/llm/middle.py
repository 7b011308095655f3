"""Fill-in-middle transformation: places of units found by arithmetic on 64-bit words of UTF-8."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumastack.llm.shared import text_blocks

#: The signs before prefix, suffix and middle.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Text that is looked at together.
BLOCK_BYTES = 4 << 20


def every(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return np.uint64(byte * 0x0101010101010101)


HIGH, LOW7 = every(0x80), every(0x7F)
ONE, SEVEN, EIGHT, TOP = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


def next_bytes(marks: np.ndarray) -> np.ndarray:
    """For each byte the mark of the byte after it (none after the last)."""
    after = np.append(marks[1:], np.uint64(0))
    return (marks >> EIGHT) | (after << TOP)


def letters(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter: sums of seven bits cannot reach the next byte."""
    folded = (words | every(0x20)) & LOW7
    return (folded + every(0x80 - ord("a"))) & ~(folded + every(0x7F - ord("z"))) & ~words & HIGH


def continuations(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte 10xxxxxx, one that continues a character."""
    return words & ~(words << ONE) & HIGH


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that ends a unit: a run of ASCII letters, or any other character. It does unless a continuation
    follows, or it and the next are letters."""
    letter = letters(words)
    return ~(next_bytes(continuations(words)) | (letter & next_bytes(letter))) & HIGH


class Ranks:
    """Rank and select over marked bytes (their high bits) of words."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, byte: np.ndarray) -> np.ndarray:
        """How many marks lie before each byte."""
        word, inside = byte >> 3, (byte & 7).astype(np.uint64)
        below = (ONE << (inside * EIGHT)) - ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark (from 1): its word from the cumulative counts, then the byte from the word's running counts."""
        word = np.searchsorted(self.before, k, side="left") - 1
        running = (self.marks[word] >> SEVEN) * every(1)  # byte j: marks in bytes 0 to j
        wanted = (k - self.before[word]).astype(np.uint64)
        reached = ((running | HIGH) - wanted * every(1)) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def cut_texts(texts: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, first, second, prefix_chars, middle_chars) of each text: its units, the bytes at which its prefix and its middle end, and
    their code points. The prefix ends after the smaller of a % (n + 1) and b % (n + 1) units, the middle after the larger.

    All texts are one buffer with a zero byte after each, which is a unit of its own: so no unit or character goes on from one
    text into the next.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(sizes + 1)
    start = stop - sizes - 1
    data = b"\0".join([*texts, b""])
    words = np.frombuffer(data + bytes(-len(data) % 8 + 8), "<u8")
    ends, characters = Ranks(unit_ends(words)), Ranks(~continuations(words) & HIGH)
    seen = ends.rank(start)
    n = ends.rank(start + sizes) - seen
    low, high = np.minimum(a % (n + 1), b % (n + 1)), np.maximum(a % (n + 1), b % (n + 1))
    cuts = [np.where(k > 0, ends.select(np.maximum(1, seen + k)) + 1, start) for k in (low, high)]
    chars = [characters.rank(at) for at in (start, *cuts)]
    return n, cuts[0] - start, cuts[1] - start, chars[1] - chars[0], chars[2] - chars[1]


def compose(text: bytes, first: int, second: int, form: str) -> bytes:
    """The training text of a form: the parts of text, each after its sign."""
    p, s, m = (x.encode() for x in MARKS.values())
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((p, text[:first], s, text[second:], m, text[first:second]))
    return b"".join((s, text[second:], p, text[:first], m, text[first:second]))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was composed of. A text with one of the signs in it is never taken apart, so each sign's first place is its own."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in MARKS.values())
    rest, middle = output.split(m)
    one, two = rest[len(p) :].split(s if form == "psm" else p)
    return one + middle + two if form == "psm" else two + middle + one


def draws(id_col: Column, seed: int, how_many: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex SHA-256 of `seed:id`, as numbers; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(how_many)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, *, outputs: bool = True, digests: bool = False) -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars; with outputs the new text, with digests the SHA-256 of it and of the
    text that restore() makes of it.

    Units are runs of ASCII letters and single other characters, n is how many a text has. Four numbers drawn from seed and id
    decide: the first two where the middle begins and ends, the third whether the text is taken apart at all (`rate` in 100
    are), the fourth in which form (`spm` in 100: suffix, prefix, middle; the rest: prefix, suffix, middle). An empty text, and one
    that holds a sign of MARKS, stays plain; prefix_chars and middle_chars are null then.

    A narrow job: no shuffle, blocks of BLOCK_BYTES (a longer text is a block of its own), each row a function of its id and
    text alone. A null text counts as empty; rows that repeat an id are cut by the same numbers. Other columns play no part.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            texts = pc.fill_null(block.column("text"), "").cast(pa.binary()).to_pylist()
            h = [block.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
            n, first, second, prefix, middle = cut_texts(texts, h[0], h[1])
            marked = np.array([any(m.encode() in t for m in MARKS.values()) for t in texts], bool)
            plain = (n == 0) | marked | (h[2] % 100 >= rate)
            forms = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm")).tolist()
            made = list(map(compose, texts, first.tolist(), second.tolist(), forms))
            out = {"id": block.column("id"), "n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(prefix, pa.int64(), mask=plain), "middle_chars": pa.array(middle, pa.int64(), mask=plain)}
            if outputs:
                out["output"] = pa.array(made, pa.binary()).cast(pa.string())
            if digests:
                out["output_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string())
                out["restored_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in map(restore, made, forms)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).alias("id"), *[h.alias(f"h{i + 1}") for i, h in enumerate(draws(F.col(id_col), seed))], F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n bigint, form string, prefix_chars bigint, middle_chars bigint" + ", output string" * outputs + ", output_sha256 string, restored_sha256 string" * digests
    return rows.mapInArrow(blocks, schema).withColumnRenamed("id", id_col)
