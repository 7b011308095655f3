"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumastack.llm.shared import doc_chunks, materialise, text_blocks, words_of

#: Rows of each language that the fit looks at, at most: those with the smallest hashes of id and text.
FIT_ROWS = 2_500
#: n-grams enter a language's filter if they are at least this part of its n-grams; so at most 1 / SHARE enter.
SHARE = 1 / 20_000
#: ... and at least this part of their share in the language where they are most frequent, so that foreign passages do not count.
OF_BEST = 0.3
GRAM = 3


def letters_only(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased words, each between two blanks, other signs than letters as blanks; and the word of each."""
    lower = pc.utf8_lower(words.cast(pa.large_string()))
    codes = np.frombuffer(" ".join(["", *lower.to_pylist(), ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.cumsum(codes == 32) - 1
    known = np.unique(codes)
    is_letter = np.array([chr(c).isalpha() for c in known.tolist()], bool)
    return np.where(is_letter[np.searchsorted(known, codes)], codes, 32), word


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (code points packed into 63 bits) that hold a letter in the middle, and the word of each."""
    codes, word = letters_only(words)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.zeros(n, np.int64)
    for j in range(GRAM):
        packed = packed << 21 | codes[j : n + j]
    middle = codes[1 : n + 1] != 32
    return packed[middle], word[1 : n + 1][middle]


def places(keys: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """The slots of each key."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33) | np.uint64(1)
    return [((h >> np.uint64(20)) + np.uint64(i) * step) % np.uint64(slots) for i in range(hashes)]


@dataclass
class LanguageFilters:
    """One Bloom filter for each language, sliced by bit: a slot holds a bitmask of the languages whose filter has it set.

    A look-up takes the AND of the masks in an n-gram's slots and so gives all languages that may contain it at once. Masks
    have as many 64-bit words as the languages need: slots is (words, slots).
    """

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray

    @classmethod
    def of(cls, members: dict[str, np.ndarray], hashes: int = 3, per_gram: int = 16) -> LanguageFilters:
        languages = sorted(members)
        slots = np.zeros((-(-len(languages) // 64), max(64, per_gram * max([0, *(len(m) for m in members.values())]))), np.uint64)
        for i, name in enumerate(languages):
            for at in places(members[name], slots.shape[1], hashes):
                np.bitwise_or.at(slots[i // 64], at, np.uint64(1 << i % 64))
        filled = [((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        return cls(languages, slots, hashes, np.array(filled) ** hashes)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """A bitmask of languages for each n-gram: (words, n-grams)."""
        masks = [self.slots[:, at] for at in places(keys, self.slots.shape[1], self.hashes)]
        return np.bitwise_and.reduce(masks)

    def word_counts(self, words: pa.Array, part: int = 50_000) -> np.ndarray:
        """For each word its n-grams and, for each language, how many of them the filter holds (1 + languages, words), `part` words at a time."""
        parts = [self._word_counts(words.slice(i, part)) for i in range(0, len(words), part)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((1 + len(self.languages), 0), np.int32)

    def _word_counts(self, words: pa.Array) -> np.ndarray:
        out = np.zeros((1 + len(self.languages), len(words)), np.int32)
        keys, word = grams(words)
        if not len(keys):
            return out
        masks = self.contains(keys)
        out[0] = np.bincount(word, minlength=len(words))
        for i in range(len(self.languages)):
            out[1 + i] = np.bincount(word[(masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(words))
        return out

    def corrected(self, counts: np.ndarray) -> np.ndarray:
        """Counts of true members from popcounts: what false positives add is taken off."""
        n, hits = counts[:, :1], counts[:, 1:]
        return np.maximum(0, (hits - n * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> LanguageFilters:
    """Filters of all languages, from at most `rows` labelled rows of each (those with the smallest hashes of id and text; so a
    rare language keeps its rows as the table grows). The driver gets n-grams only, at most 1 / SHARE a language. Rows
    without a language or text are left out. Rows that repeat id, text and language count once, in the sample as in its size, so a
    language with many repeated rows keeps as many different ones as any other."""
    use = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # hashes are even, so of n different rows (their number need not be exact) some 2 * rows lie under this part of their range: the exact
    # place is sought among these alone
    sizes = use.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("all"))
    low = use.select("lang", "h").join(F.broadcast(sizes), "lang").where(F.col("h") / 2.0**64 + 0.5 <= 2.0 * rows / F.col("all")).select("lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = low.withColumn("n", place).where(F.col("n") <= rows).groupBy("lang").agg(F.max("h").alias("last"))
    use = use.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last")).dropDuplicates(["lang", "h"])  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for name in pc.unique(langs).to_pylist():
                own = batch.filter(pc.equal(langs, name))
                for block in text_blocks(iter([own])):
                    words, flat, _ = words_of(block.column("text"))
                    times = np.bincount(flat, minlength=len(words))
                    keys, word = grams(words)
                    known, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, weights=times[word], minlength=len(known)).astype(np.int64) if len(known) else known
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(known), pa.string()), "gram": pa.array(known, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = materialise(use.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= SHARE)
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    frequent = shares.join(best, "gram").where(F.col("share") >= OF_BEST * F.col("best")).select("lang", "gram").toPandas()
    return LanguageFilters.of({k: v["gram"].to_numpy() for k, v in frequent.groupby("lang")})


def judge(texts: pa.Array, filters: LanguageFilters) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of a block."""
    words, flat, starts = words_of(texts)
    counts = filters.word_counts(words)
    total = np.zeros((len(texts), len(counts)), np.int64)
    for first, last in doc_chunks(starts):
        chunk, at = flat[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        for i, own in enumerate(counts):
            sums = np.concatenate(([0], np.cumsum(own[chunk], dtype=np.int64)))
            total[first:last, i] = sums[at[1:]] - sums[at[:-1]]
    true = filters.corrected(total)
    lettered = (total[:, 0] > 0) & bool(filters.languages)
    best = true.argmax(1) if filters.languages else np.zeros(len(true), np.int64)
    score = np.where(lettered, true.max(1, initial=0) / np.maximum(1e-9, true.sum(1)), 0.0)
    return [filters.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def language_of(text: Column, filters: LanguageFilters, spark: SparkSession) -> Column:
    """STRUCT(lang_pred, score) of a text: the language whose filter, corrected for false positives, holds most of the n-grams;
    score is its part of all languages' counts.

    `und` with score 0 if the text is null or has no letter (or nothing was learned). A text none of whose n-grams is known
    gets the first language by name, with score 0; so do ties get the first. Whole texts count, each distinct word of a
    block being looked up once. Only texts go to Python, in Arrow batches, and no row comes back from there. The filters'
    size is bounded by SHARE and the number of languages; they are broadcast.
    """
    held = spark.sparkContext.broadcast(filters)

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        parts = [judge(b.column("text"), held.value) for b in text_blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))]
        names = pa.array([n for p in parts for n in p[0]], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(np.concatenate([p[1] for p in parts]) if parts else [], pa.float64())], ["lang_pred", "score"])

    return of(text.cast("string"))


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, lang_pred, score) of every document, by language_of."""
    found = language_of(F.col(text_col), filters, docs.sparkSession)
    return docs.select(F.col(id_col), *carry, found.alias("_found")).select(id_col, *carry, "_found.lang_pred", "_found.score")
