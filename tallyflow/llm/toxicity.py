"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A writer's word comes out as leetspeak, with signs between its letters, with letters repeated or spaced out.
Each suspicious run of characters is a lattice: a character stands for itself, for what it may replace (``1`` for i
or l, ``$`` for s), for nothing (a sign between letters) or for a repetition of the letter before; at a sign or space
a word may also end. Viterbi finds the words with the smallest cost of channel and of a character trigram model, which is
counted over the words of all documents. Restored words join the text's own words. Where there are more trigrams than the
tasks are given, parts of the texts are joined with the rarer counts that their runs ask for, so none is left out.

The score knows words and beginnings of words from labelled documents: for each, the lower bound of a
confidence interval for the share of toxic documents among those that contain it. A document's score is the
largest of its words', as one toxic word makes a document toxic, however long the rest is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from tallyflow.llm.common import fold, free_name, stage, text_or_empty
from tallyflow.llm.text import REMEMBERED, sampled_labels

#: Labelled documents that the lexicon is learned from, at most.
LABELLED = 20_000
THRESHOLD = 0.3
#: Letters of a word's beginning that are features of their own.
PREFIXES = (4, 5, 6)
#: Standard errors below the share; a word whose bound is below LEAST says nothing,
# one from CERTAIN on explains its documents.
Z, LEAST, CERTAIN = 3.0, 0.3, 0.7
#: Letters of words by which copies among the labelled documents are told.
LONG_WORD = 8
MODULUS, HELD_OUT = 4, 2

# The letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs of the channel in nats: a replaced letter, a sign that stands for nothing, a repeated letter.
REPLACED, NOTHING, REPEATED = 0.7, 0.7, 0.1

LETTER = r"[^\W\d_]"
WORDS = re.compile(rf"{LETTER}+")
# Within a token: letters with digits or signs among them, or three equal letters. A run of letters or of signs for letters
# is entered at its beginning only and never given back in part, so a token of any length is read in linear time.
LEETS = r"[0-9@$!|+(€£¡]"
RESTS = r"[\w@$!|+(€£¡*.\-]*+"
SUSPICIOUS = re.compile(
    rf"(?<!{LEETS})(?:{LEETS}++|(?<!{LETTER})){LETTER}++(?:[^\w\s]|[\d_])++{LETTER}{RESTS}"
    rf"|(?<!{LEETS}){LEETS}++{LETTER}{RESTS}"
    rf"|(?<!{LETTER}){LETTER}*?({LETTER})\1\1{LETTER}*+"
)
# Across tokens: four or more single letters, digits or signs for letters, with a space or sign between.
SINGLE = r"(?:[^\W_]|[@$!|+(€£¡])"
SPACED = re.compile(rf"(?<![^\W_]){SINGLE}(?:[ .\-_*]{{1,2}}{SINGLE}(?![^\W_])){{3,}}")
THREE = re.compile(r"(.)\1\1")
EDGE = "\x02"


class CharModel:
    """Trigrams of the letters of words, with add-one smoothing; ``EDGE`` marks the two ends.

    ``counts`` are all trigrams; or, with ``size`` third letters in all, trigrams and the pairs of letters they begin with.
    """

    def __init__(self, counts: dict[str, int], size: int | None = None) -> None:
        if size is None:
            pairs: Counter[str] = Counter()
            for gram, n in counts.items():
                pairs[gram[:2]] += n
            counts, size = {**counts, **pairs}, max(2, len({g[2] for g in counts}))
        self.given, self.counts, self.size = counts, counts, size
        self.memo: dict[tuple[str, str], float] = {}

    def learn(self, more: dict[str, int]) -> None:
        """Counts for the runs that come next; costs remembered from earlier runs hold, for those knew theirs."""
        if len(self.counts) + len(more) > len(self.given) + REMEMBERED:
            self.counts = self.given
        self.counts = {**self.counts, **more}

    def cost(self, two: str, letter: str) -> float:
        key = two, letter
        if key not in self.memo:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            self.memo[key] = -math.log((self.counts.get(two + letter, 0) + 0.5) / (self.counts.get(two, 0) + 0.5 * self.size))
        return self.memo[key]


class Asking(CharModel):
    """Notes the pairs and trigrams that runs ask for and that are not among the counts; those of a run do not depend on costs."""

    def __init__(self, counts: dict[str, int], size: int) -> None:
        super().__init__(counts, size)
        self.asked: set[str] = set()

    def cost(self, two: str, letter: str) -> float:
        self.asked.update(key for key in (two, two + letter) if key not in self.counts)
        return 0.0


def readings(c: str) -> list[tuple[str, float]]:
    """Letters that a character may stand for, with costs; an empty one stands for nothing."""
    if c.isalpha():
        return [(c, 0.0)]
    out = [(letter, REPLACED) for letter in LEET.get(c, "")]
    return out if c.isdigit() else [*out, ("", NOTHING)]


def restore(run: str, model: CharModel) -> list[str]:
    """The likeliest words of a run of characters, in lower case; a word may end at any sign or space."""
    # A state is the last two letters; a letter equal to the one before may be a repetition. What was read is a
    # chain of (chain before, letter), so that a step costs the same however long the run is.
    states: dict[str, tuple[float, tuple | None]] = {EDGE * 2: (0.0, None)}
    for c in run.lower():
        new: dict[str, tuple[float, tuple | None]] = {}
        ends = not c.isalnum()
        for two, (cost, out) in states.items():
            steps = []
            for letter, extra in readings(c) or [("", NOTHING)]:
                if letter == "":
                    steps.append((two, cost + extra, out))
                    continue
                steps.append((two[1] + letter, cost + extra + model.cost(two, letter), (out, letter)))
                if two[1] == letter:
                    steps.append((two, cost + extra + REPEATED, out))
            if ends and two[1] != EDGE:
                steps.append((EDGE * 2, cost + NOTHING + model.cost(two, EDGE), (out, " ")))
            for state, total, read in steps:
                if state not in new or total < new[state][0]:
                    new[state] = total, read
        states = new
    _, out = min(((cost + (0.0 if two[1] == EDGE else model.cost(two, EDGE)), out) for two, (cost, out) in states.items()), key=lambda s: s[0])
    letters = []
    while out:
        out, letter = out
        letters.append(letter)
    return "".join(reversed(letters)).split(" ")


class Restorer:
    """The words of texts, restored ones too, by token."""

    def __init__(self, counts: dict[str, int], size: int | None = None, model: type[CharModel] = CharModel) -> None:
        self.model = model(counts, size)
        self.tokens: dict[str, list[str]] = {}

    def _restored(self, run: str) -> list[str]:
        return [w for w in restore(run, self.model) if len(w) > 2]

    def of_token(self, token: str) -> list[str]:
        """Words of a run without white space; remembered."""
        if token not in self.tokens:
            if len(self.tokens) > REMEMBERED // 2:
                self.tokens.clear()
            restored = [] if token.isalpha() and not THREE.search(token) else [w for m in SUSPICIOUS.finditer(token) for w in self._restored(m.group())]
            self.tokens[token] = [w for w in WORDS.findall(token.lower()) if len(w) > 2] + restored
        return self.tokens[token]

    def of_spaced(self, text: str) -> list[str]:
        """Words whose letters stand apart; what has no letter is numbers."""
        return [w for m in SPACED.finditer(text) if any(map(str.isalpha, m.group())) for w in self._restored(m.group())]

    def words(self, text: str) -> set[str]:
        return {w for token in set(text.split()) for w in self.of_token(token)}.union(self.of_spaced(text))


def trigrams(docs: DataFrame) -> DataFrame:
    """``gram, n`` over the words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()
        tokens: Counter[str] = Counter()

        def add() -> None:
            words: Counter[str] = Counter()
            for token, n in tokens.items():
                for word in WORDS.findall(token.lower()):
                    words[word] += n
            for word, n in words.items():
                marked = EDGE * 2 + word + EDGE
                for i in range(len(marked) - 2):
                    grams[marked[i : i + 3]] += n
            tokens.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens.update(text.split())
                if len(tokens) > REMEMBERED:
                    add()
        add()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    counted = docs.select(text_or_empty("text").alias("text")).mapInArrow(count, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


#: Counts that all tasks get, the most frequent ones; the others go to the parts of the texts whose runs ask for them.
MOST_GRAMS = 200_000
#: Characters of texts that make a part.
PART = 1_000_000


@dataclass
class Grams:
    """What ``Restorer`` takes, for all tasks; and ``gram, n`` of all trigrams and pairs, where that is not all of them."""

    known: Broadcast
    others: DataFrame | None


def grams_for_tasks(docs: DataFrame) -> Grams:
    context = docs.sparkSession.sparkContext
    counted = stage(trigrams(docs), "trigrams")
    most = counted.orderBy(F.desc("n"), "gram").limit(MOST_GRAMS + 1).collect()
    if len(most) <= MOST_GRAMS:
        return Grams(context.broadcast(({r.gram: r.n for r in most},)), None)
    size = counted.select(F.substring("gram", 3, 1)).distinct().count()
    pairs = counted.groupBy(F.substring("gram", 1, 2).alias("gram")).agg(F.sum("n").alias("n"))
    counts = stage(counted.unionByName(pairs), "trigrams-and-pairs")
    most = counts.orderBy(F.desc("n"), "gram").limit(MOST_GRAMS).collect()
    return Grams(context.broadcast(({r.gram: r.n for r in most}, max(2, size))), counts)


def in_parts(rows: DataFrame, part: str, characters: int) -> DataFrame:
    """``rows``, written, with the number of a ``part`` of about so many ``characters`` of their ``text``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            parts = []
            for text in batch.column("text").to_pylist():
                if filled >= characters:
                    at, filled = at + 1, 0
                filled += 1 + len(text or "")
                parts.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*batch.schema.names, part])

    return stage(rows.mapInArrow(number, StructType([*rows.schema.fields]).add(part, LongType())), "parts")


def asked_for(numbered: DataFrame, part: str, known: Broadcast) -> DataFrame:
    """``part, gram``: the trigrams and pairs that the runs of a part ask for and that are not ``known``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, now = Restorer(*known.value, model=Asking), None

        def asked() -> pa.RecordBatch:
            grams = sorted(r.model.asked)
            r.model.asked.clear()
            r.tokens.clear()  # a token asks anew in each part
            return pa.RecordBatch.from_arrays([pa.array([now] * len(grams), pa.int64()), pa.array(grams, pa.string())], names=["part", "gram"])

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    yield asked()
                    now = at
                r.words(text)
        yield asked()

    return numbered.select(part, text_or_empty("text")).mapInArrow(ask, "part long, gram string").distinct()


def restoring(
    rows: DataFrame, grams: Grams, begin: Callable[[Restorer], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """What a function from batches to batches makes of ``rows``; a task gets it from ``begin`` for its ``Restorer``.

    The restorer knows all counts that the runs of the ``text`` ask for. Beyond ``MOST_GRAMS`` the rows are dealt in parts, and
    those of a part meet in a task with the rarer counts it asks for; a part holds about ``PART`` characters or one text.
    """
    known = grams.known
    if grams.others is None:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from map(begin(Restorer(*known.value)), batches)

        return rows.mapInArrow(whole, schema)
    part = free_name(rows, "part_of_texts")
    numbered = in_parts(rows, part, PART)
    counts = asked_for(numbered, part, known).join(grams.others, "gram").select("part", "gram", "n")
    of_task: list = []

    def of_part(texts: pa.Table, more: pa.Table) -> pa.Table:
        if not of_task:
            r = Restorer(*known.value)
            of_task.extend([r.model, begin(r)])
        model, function = of_task
        model.learn(dict(zip(more.column("gram").to_pylist(), more.column("n").to_pylist(), strict=True)))
        return pa.Table.from_batches([function(batch) for batch in texts.drop_columns([part]).to_batches()])

    return numbered.groupBy(part).cogroup(counts.groupBy("part")).applyInArrow(of_part, schema)


def beginnings(word: str) -> list[str]:
    return [word[:k] + "-" for k in PREFIXES if len(word) > k]


def lower_bound(toxic: str, clean: str) -> Column:
    """Wilson's: the share of toxic documents is at least this, ``Z`` standard errors from what was counted."""
    n = F.col(toxic) + F.col(clean)
    share, z2 = F.col(toxic) / n, Z * Z
    return (share + z2 / (2 * n) - Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def word_counts(rows: DataFrame, grams: Grams, telling: list[str]) -> DataFrame:
    """``word, clean, toxic``: labelled texts with a word, of those without any of the ``telling`` words."""

    def begin(r: Restorer) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        told = set(telling)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = Counter(), Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = r.words(text)
                if told.isdisjoint(words):
                    counts[y].update(words)
            names = sorted(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in counts)], names=["word", "clean", "toxic"]
            )

        return count

    return restoring(rows, grams, begin, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )


def lexicon(docs: DataFrame, labelled: DataFrame, grams: Grams) -> dict[str, float]:
    """Bounds of words, and of beginnings as ``begin-``, from ``labelled`` (``doc_id, y``; bounded, each id once).

    Words that tell for certain come first. What they leave unexplained decides on the other words, else each word
    that stands beside them would gain; and what single words leave unexplained decides on beginnings.
    """
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(labelled), "doc_id").select("text", "y")
    # Copies would make every word of theirs look telling: of those with the same smallest hash of a long word
    # and the same label, one stays.
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= LONG_WORD)
    kind = F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    rows = stage(rows.groupBy(kind.alias("kind"), "y").agg(F.min("text").alias("text")), "labelled-texts")
    bound = lower_bound("toxic", "clean")
    first = word_counts(rows, grams, []).where("toxic > 0").select("word", bound.alias("bound")).where(F.col("bound") >= CERTAIN)
    known = {r.word: r.bound for r in first.collect()}
    rest = stage(word_counts(rows, grams, sorted(known)), "word-counts")
    second = rest.where("toxic > 0").select("word", bound.alias("bound")).where(F.col("bound") >= LEAST).collect()
    known.update({r.word: r.bound for r in second})
    begins = F.array(*[F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("-"))) for k in PREFIXES])
    families = (
        rest.join(F.broadcast(docs.sparkSession.createDataFrame([(r.word,) for r in second], "word string")), "word", "left_anti")
        .select(F.explode(F.array_compact(begins)).alias("begin"), "clean", "toxic")
        .groupBy("begin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 0")
        .select("begin", bound.alias("bound")).where(F.col("bound") >= LEAST)
    )
    known.update({r.begin: r.bound for r in families.collect()})
    return known


def scorer(
    docs: DataFrame, labels: DataFrame, most_labelled: int = LABELLED
) -> tuple[Grams, Callable[[Restorer], Callable[[list[str]], list[float]]]]:
    """What ``restoring`` takes, and what makes a function from texts to scores of a restorer; learned from ``docs`` and ``labels``."""
    grams = grams_for_tasks(docs)
    labelled = stage(sampled_labels(labels, "toxic", MODULUS, HELD_OUT, most_labelled), "labelled")
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs, labelled, grams))

    def begin(r: Restorer) -> Callable[[list[str]], list[float]]:
        bounds = known.value
        seen: dict[str, float] = {}

        def worst(words: list[str]) -> float:
            return max([bounds.get(f, 0.0) for w in words for f in (w, *beginnings(w))], default=0.0)

        def score(texts: list[str]) -> list[float]:
            scores = []
            for text in texts:
                tokens = set(text.split())
                if len(seen) > REMEMBERED:
                    seen.clear()
                for token in tokens.difference(seen):
                    seen[token] = worst(r.of_token(token))
                scores.append(max(max(map(seen.__getitem__, tokens), default=0.0), worst(r.of_spaced(text))))
            return scores

        return score

    return grams, begin


def toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    Labels (``doc_id``, ``toxic``) are learned from rows outside the held-out fold only, at most ``most_labelled``
    of them. A null or empty text scores 0. Without labels every score is 0. Repeated rows and null ids
    come out as they are; extra columns are left behind. The lexicon is bounded by ``most_labelled`` (a feature needs several
    toxic documents), the counts that all tasks get by ``MOST_GRAMS``; all other trigrams go where they are asked for.
    """
    grams, begin = scorer(docs, labels, most_labelled)

    def scoring(r: Restorer) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        score = begin(r)

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array(score(batch.column("text").to_pylist()), pa.float64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

        return scored

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (fold("doc_id", MODULUS) == HELD_OUT).alias("held_out"), text_or_empty("text").alias("text"))
    done = restoring(rows, grams, scoring, f"doc_id {kind}, held_out boolean, score double")
    return done.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all its columns (of types that Arrow has), less the rows predicted toxic.

    Each row is judged by its own text, whatever its id and whichever other rows have that id.
    """
    grams, begin = scorer(docs, labels)

    def keeping(r: Restorer) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        score = begin(r)

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = score([t or "" for t in batch.column("text").to_pylist()])
            return batch.filter(pa.array([x < THRESHOLD for x in scores], pa.bool_()))

        return keep

    return restoring(docs, grams, keeping, docs.schema)
