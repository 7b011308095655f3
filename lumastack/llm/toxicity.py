"""Toxicity scores by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumastack.llm.shared import doc_chunks, gather, materialise, text_blocks, words_of

#: Labelled rows that the fit looks at, at most: those with the smallest hashes of their ids.
FIT_ROWS = 12_000
#: A stem is learned from this part of the toxic rows on, with at least this log-odds; as a threat if at least THREATENS of its toxic rows
#: have it shortly after a word of intent, else as an insult.
SUPPORT, LEAST_WEIGHT, THREATENS = 0.02, 2.5, 0.5

OTHER, NEGATION, REPORT, TARGET, INTENT, THREAT, INSULT, STRONG, END, OPEN, CLOSE, QUOTE, PARAGRAPH = range(13)
#: Closed word classes of the grammar, in four languages. Insults, and threats beside these verbs, are learned.
WORDS = {
    NEGATION: "not never no isn't aren't don't doesn't nicht nie kein keine pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say told wrote quoted reported called claimed dit disait écrit sagte sagt schrieb meldete dijo dice escribió",
    TARGET: "you your you're they them he him she her tu toi vous te du dich ihr euch usted ustedes ti",
    INTENT: "will shall gonna going i'll we'll want must should werde werden wird wollen soll vais va veux allons voy va quiero vamos debe",
    THREAT: "kill hurt destroy shoot stab burn beat threaten tuer frapper brûler détruire töten schlagen verletzen zerstören matar golpear quemar destruir",
    STRONG: "such so very total totally complete utter utterly absolute really sehr völlig absolut très vraiment tellement muy totalmente tan",
}
CLASS = {w: c for c, words in WORDS.items() for w in words.split()}
SIGNS = {c: END for c in ".!?;"} | {'"': QUOTE, "“": OPEN, "„": OPEN, "«": OPEN, "”": CLOSE, "»": CLOSE, "¶": PARAGRAPH}
PART = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;]|[\"“”„«»¶]")
#: A blank line ends a paragraph.
BLANK_LINE = r"\n[ \t\r]*\n"
KINDS, MODES = ("insult", "threat", "intent"), ("plain", "negated", "reported", "denied")
#: What the grammar counts: clauses by the best path through them, kind x (with target or without) x mode; the clauses that match at all; the weight of all by the length of the text.
FEATURES = [f"{kind}{at}_{mode}" for kind in KINDS for at in ("", "_at_target") for mode in MODES] + ["clauses", "density"]
#: Weights that the transducers put on a path.
STRONGER, INTENDED, AIMED, NEGATED, REPORTED = 1.25, 1.5, 1.5, 0.4, 0.5
#: Words of a clause that the transducers look over.
REACH, NEGATION_REACH, REPORT_REACH = 4, 3, 8


@dataclass
class Transducer:
    """A deterministic weighted transducer over word classes: step(state, class) -> (state, what it says of this word)."""

    start: object
    step: callable


def reach(opens: int, words: int) -> Transducer:
    """Says whether a word of class `opens` is among the `words` words before, in the clause."""

    def step(left, symbol):
        if symbol >= END:
            return (0 if symbol in (END, PARAGRAPH) else left), False
        return (words if symbol == opens else max(0, left - 1)), left > 0

    return Transducer(0, step)


def insult() -> Transducer:
    """The weight of an insult, more after a strengthening word; None for other words."""
    strong = reach(STRONG, 2)

    def step(state, symbol):
        state, near = strong.step(state, symbol)
        return state, (STRONGER if near else 1.0) if symbol == INSULT else None

    return Transducer(0, step)


def threat() -> Transducer:
    """(kind, weight) of a threat: `intent` if someone will, wants to or should do it; None for other words."""
    will = reach(INTENT, REACH)

    def step(state, symbol):
        state, near = will.step(state, symbol)
        return state, ((2, INTENDED) if near else (1, 1.0)) if symbol == THREAT else None

    return Transducer(0, step)


def target() -> Transducer:
    """For an insult or threat, whether a target stands shortly before; for a target, whether an insult or threat does."""
    before, after = reach(TARGET, REACH), {hot: reach(hot, REACH) for hot in (INSULT, THREAT)}

    def step(state, symbol):
        state = list(state)
        state[0], aimed = before.step(state[0], symbol)
        hot = False
        for i, r in enumerate(after.values(), 1):
            state[i], near = r.step(state[i], symbol)
            hot |= near
        return tuple(state), aimed if symbol in (INSULT, THREAT) else hot if symbol == TARGET else False

    return Transducer((0, 0, 0), step)


def negation() -> Transducer:
    return reach(NEGATION, NEGATION_REACH)


def reported() -> Transducer:
    """Says whether a word is reported speech: after a verb of speech in the clause, or in a quotation. A quotation goes on over clauses to
    its closing sign, however far; one that is left open ends with its paragraph."""
    verb = reach(REPORT, REPORT_REACH)

    def step(state, symbol):
        left, quoted = state
        left, near = verb.step(left, symbol)
        said = near or quoted
        if symbol == OPEN or symbol == QUOTE and not quoted:
            quoted = True
        elif symbol in (CLOSE, QUOTE):
            quoted, left = False, 0
        elif symbol == PARAGRAPH:
            quoted = False
        return (left, quoted), said

    return Transducer((0, False), step)


class Composed:
    """The five transducers as one, its states made as they are met: rows[state][class] is (next state, None, a match, or True for a target after one).

    A match is (kind, weight, whether at a target, mode).
    """

    def __init__(self):
        self.parts = [insult(), threat(), target(), negation(), reported()]
        first = tuple(p.start for p in self.parts)
        self.states, self.index = [first], {first: 0}
        self.rows: list[list] = [[None] * 13]

    def meet(self, state: int, symbol: int) -> tuple:
        stepped = [p.step(s, symbol) for p, s in zip(self.parts, self.states[state], strict=True)]
        onward = tuple(s for s, _ in stepped)
        if onward not in self.index:
            self.index[onward] = len(self.states)
            self.states.append(onward)
            self.rows.append([None] * 13)
        bad, menace, aimed, negated, said = (x for _, x in stepped)
        found = True if symbol == TARGET and aimed else None
        if bad is not None or menace is not None:
            kind, weight = menace or (0, bad)
            weight *= (AIMED if aimed else 1) * (NEGATED if negated else 1) * (REPORTED if said else 1)
            found = (kind, weight, aimed, 2 * said + negated)
        cell = self.rows[state][symbol] = (self.index[onward], found)
        return cell

    def clauses(self, symbols: list[int], weights: list[float]) -> Iterator[tuple[int, float]]:
        """(feature, weight) of the best path through each clause that has a match. A target shortly after a match is its target too."""
        state, best, last = 0, None, None
        for symbol, weight in zip(symbols, weights, strict=True):
            state, found = self.rows[state][symbol] or self.meet(state, symbol)
            if symbol in (END, PARAGRAPH):
                if best:
                    yield best[1], best[0]
                best = last = None
                continue
            if found is None:
                continue
            if found is True:
                if last is None or last[2]:
                    continue
                last = (last[0], last[1] * AIMED, True, last[3])
            else:
                last = (found[0], found[1] * weight, found[2], found[3])
            path = (last[1], 8 * last[0] + 4 * last[2] + last[3])
            best = max(best, path) if best else path
        if best:
            yield best[1], best[0]


def parts_of(word: str) -> list[str]:
    """Lower-case words and signs within a run of other than white space."""
    low = word.lower()
    return [low] if low.isalpha() else PART.findall(low)


def stems(word: str) -> tuple[str, ...]:
    """What is learned about a word: itself and its first four letters."""
    return (f"={word}", word[:4]) if len(word) >= 4 else (f"={word}",)


@dataclass
class Grammar:
    """Learned stems of insults and of threats with weights, and the logistic weights of the features."""

    lexicon: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    center: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def classes(self, word: str) -> tuple[list[int], list[float]]:
        """The classes and weights of a word's parts."""
        symbols, weights = [], []
        for part in parts_of(word):
            if part in SIGNS:
                symbols.append(SIGNS[part])
                weights.append(0.0)
                continue
            insult, menace = (max(known.get(s, 0.0) for s in stems(part)) for known in (self.lexicon, self.threats))
            symbols.append(THREAT if menace > insult else INSULT if insult else CLASS.get(part, OTHER))
            weights.append(max(insult, menace) or 1.0)
        return symbols, weights

    def features(self, texts: pa.Array) -> np.ndarray:
        """Sums of the clauses' weights for each text and feature. Only texts with an insult or a threat are walked through."""
        clauses = FEATURES.index("clauses")
        out = np.zeros((len(texts), len(FEATURES)))
        words, flat, starts = words_of(pc.replace_substring_regex(texts, pattern=BLANK_LINE, replacement=" ¶ "))
        found = [self.classes(w) for w in words.to_pylist()]
        at = np.cumsum([0, *(len(s) for s, _ in found)])
        symbols = np.array([x for s, _ in found for x in s], np.int8)
        weights = np.array([x for _, w in found for x in w])
        hot = np.array([INSULT in s or THREAT in s for s, _ in found], bool)
        grammar = Composed()
        for first, last in doc_chunks(starts):
            chunk = flat[starts[first] : starts[last]]
            any_hot = np.concatenate(([0], np.cumsum(hot[chunk])))[starts[first : last + 1] - starts[first]]
            for i in np.flatnonzero(np.diff(any_hot)).tolist():
                own = flat[starts[first + i] : starts[first + i + 1]]
                row = out[first + i]
                for k, weight in grammar.clauses(gather(symbols, at, own).tolist(), gather(weights, at, own).tolist()):
                    row[k] += weight
                    row[clauses] += 1
        out[:, clauses + 1] = 100 * out[:, :clauses].sum(1) / np.sqrt(np.maximum(25, np.diff(starts)))
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))

    def learn(self, features: np.ndarray, labels: np.ndarray) -> None:
        """Logistic weights by Newton steps with a small ridge; the prior alone without both labels."""
        self.center, spread = features.mean(0), features.std(0)
        self.scale = np.where(spread > 0, spread, 1.0)
        x = np.column_stack(((features - self.center) / self.scale, np.ones(len(features))))
        w = np.zeros(x.shape[1])
        ridge = np.eye(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + w)
        self.weights = w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Grammar:
    """A grammar from at most `rows` labelled rows. The driver gets the stems of at least SUPPORT of the toxic rows, and `rows` rows of feature sums.

    Labels other than 0 and 1 are left out; of labels that repeat an id the larger one counts, and of documents that repeat
    a labelled id one text, the smallest. Documents are read once for the fit: the sample's texts are stored. Without
    labels of both kinds nothing is learned, and all scores are 0.5. A learned stem is one of threats if most of its toxic rows
    have it at most REACH words after a word of intent.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(marks), "id")  # `rows` marks at most
    use = materialise(texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text"))
    own = Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        total: Counter = Counter()
        for batch in batches:
            for block in text_blocks(iter([batch])):
                words, flat, starts = words_of(block.column("text"))
                parts = [parts_of(w) for w in words.to_pylist()]
                known = [tuple({s for p in own if p[0].isalnum() for s in stems(p)}) for own in parts]
                will = np.array([any(CLASS.get(p) == INTENT for p in own) for own in parts], bool)
                for label, i, j in zip(block.column("label").to_pylist(), starts, starts[1:], strict=False):
                    total[label] += 1
                    near = np.convolve(will[flat[i:j]], np.ones(REACH), "full")[: j - i] if j > i else np.zeros(0)
                    after = np.concatenate(([False], near[:-1] > 0))[: j - i]
                    for s in {s for w in np.unique(flat[i:j]).tolist() for s in known[w]}:
                        seen.setdefault(s, Counter())[label] += 1
                    if label:
                        for s in {s for w in np.unique(flat[i:j][after]).tolist() for s in known[w]}:
                            seen[s]["after"] += 1
        rows = [("", total[1], total[0], 0)] + [(s, c[1], c[0], c["after"]) for s, c in seen.items()]
        yield pa.RecordBatch.from_pydict({"stem": pa.array([r[0] for r in rows], pa.string())} | {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("toxic", "clean", "after"), 1)})

    counted = use.mapInArrow(count, "stem string, toxic bigint, clean bigint, after bigint").groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "after")])
    counted = materialise(counted)
    totals = counted.where("stem = ''").first()
    n1, n0 = (totals["toxic"], totals["clean"]) if totals else (0, 0)
    if not n1 or not n0:
        return own
    enough = max(5, SUPPORT * n1)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    frequent = counted.where((F.col("stem") != "") & (F.col("toxic") >= enough)).select("stem", weight.alias("w"), (F.col("after") >= THREATENS * F.col("toxic")).alias("threat")).where(F.col("w") >= LEAST_WEIGHT)
    learned = frequent.collect()
    own.lexicon, own.threats = ({r["stem"]: float(r["w"]) for r in learned if r["threat"] == kind} for kind in (False, True))
    held = docs.sparkSession.sparkContext.broadcast(own)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(iter([batch])):
                yield pa.RecordBatch.from_pydict({"label": block.column("label"), "f": pa.array(list(held.value.features(block.column("text"))), pa.list_(pa.float64()))})

    sample = use.mapInArrow(measure, "label int, f array<double>").toPandas()
    own.learn(np.stack(sample["f"].to_numpy()), sample["label"].to_numpy().astype(float))
    return own


def score(docs: DataFrame, model: Grammar, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, score, predicted) per document; predicted is 1 from a score of 0.5 on.

    Each word belongs to a class. Five weighted transducers read the classes as one composed machine: insults and threats
    start a path, targets before or after them, negation and reported speech (verbs of speech, quotations) change its
    weight. A quotation goes on to its closing sign; one left open ends with its paragraph (at a blank line). A clause counts
    once, by its best path, under that path's kind, target and mode; lone insults are clauses of the plain kind. Logistic weights turn the sums into a score. A null or empty text has the score of a text without matches.
    Whole texts count. The model is broadcast; its size is bounded by SUPPORT and the rows of the fit.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            s = held.value.score(held.value.features(block.column("text")))
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*block.schema.names[:-1], "score", "predicted"])

    rows = docs.select(F.col(id_col), *carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(blocks, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
