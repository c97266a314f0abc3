"""Secret scan: candidates by shape, false positives removed by a random forest, all inside Spark's own functions.

A candidate is a long run of the characters keys are made of. Its features are its length, how its characters
change from kind to kind, how much of it frequent words of the corpus cover, the path it was found under and the words
beside it. The forest is trained by Spark's ML library on a bounded number of labelled findings and then written out
as a column expression, so that scoring stays in the row of the document: no candidate is ever shuffled, and a
document with a million of them is no different from any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tallyflow.llm.common import free_name, stage, text_or_empty

SHAPE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Characters on each side that count as neighbours.
BESIDE = 32
#: Frequent short words that count as a dictionary, and their letters.
DICTIONARY, SHORT = 150, r"(?<![\p{L}\d])[a-z]{2,6}(?![\p{L}\d])"
#: Labelled findings of each kind that the forest is trained on, at most.
LABELLED = 3_000
TREES, DEPTH = 20, 5
THRESHOLD = 0.5
#: Candidates whose lengths are summed together on the way to their positions.
BLOCK = 128
MASK = "[SECRET]"

NAMING = r"(?i)(pass(word|wd)?|token|secret|key|auth|bearer|credential)[\w-]*[\"'\s:=]*$"
FEATURES = ("chars", "kinds", "digits", "uppers", "covered", "steps", "sample_path", "named", "assigned", "quoted", "hex")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _starts(f: Column) -> Column:
    """Where each of ``f.matches`` begins, from 0: the lengths of all ``f.pieces`` and matches before, summed by blocks."""
    zero = F.lit(0).cast("bigint")
    total = lambda numbers: F.aggregate(numbers, zero, lambda a, b: a + b)
    n = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def of_lengths(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(lengths) - 1)), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
        bases = let(blocks, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))
        return let(bases, lambda base: F.transform(
            f["matches"],
            lambda _, i: F.get(base, block(i)) + total(F.slice(lengths, block(i) * BLOCK + 1, i % BLOCK)) + n(F.get(f["pieces"], i)),
        ))

    return let(F.zip_with(f["pieces"], f["matches"], lambda piece, match: n(piece) + n(match)), of_lengths)


def candidates(text: Column, source: Column, dictionary: list[str]) -> Column:
    """Array of all candidates of a text, each as often as it occurs: ``candidate, start`` (from 0) and the features."""
    words = "|".join(sorted(map(re.escape, dictionary), key=lambda w: (-len(w), w))) or r"(?!)"

    def described(f: Column, starts: Column, c: Column, i: Column) -> Column:
        n = F.length(c)
        # As candidates have half of BESIDE or more, two of them and the pieces around hold all that counts as beside.
        near = [F.get(f["pieces"], i - 2), F.get(f["matches"], i - 2), F.get(f["pieces"], i - 1), F.get(f["matches"], i - 1), F.get(f["pieces"], i)]
        before = F.substring(F.concat_ws("", *near), -BESIDE, BESIDE)
        after = F.get(f["pieces"], i + 1)
        share = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
        flag = lambda condition: condition.cast("double")
        return F.struct(
            c.alias("candidate"), F.get(starts, i).alias("start"),
            n.cast("double").alias("chars"),
            (F.length(F.regexp_replace(c, "[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", "x")) / n).alias("kinds"),
            share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"),
            ((n - F.length(F.regexp_replace(F.lower(c), words, ""))) / n).alias("covered"),
            share("/").alias("steps"), flag(source.rlike("(?i)test|example|sample|doc")).alias("sample_path"),
            flag(before.rlike(NAMING)).alias("named"), flag(before.rlike("[=:]\\s*[\"']?$")).alias("assigned"),
            flag(after.rlike("^[\"']")).alias("quoted"), flag(c.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        )

    found = F.struct(F.regexp_extract_all(text, F.lit(SHAPE), F.lit(0)).alias("matches"), F.split(text, SHAPE, -1).alias("pieces"))
    return let(found, lambda f: let(_starts(f), lambda starts: F.transform(f["matches"], lambda c, i: described(f, starts, c, i))))


def dictionary_of(docs: DataFrame) -> list[str]:
    """The most frequent short words of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_or_empty("text")), F.lit(SHORT), F.lit(0))).alias("w"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY)
    return [r.w for r in top.collect()]


def labelled_by_form(docs: DataFrame, dictionary: list[str]) -> DataFrame:
    """Labelled findings where no reviewed ones are at hand: ``y`` and the features.

    1 for the form of an issued key, or digits in what a secret's name is assigned; 0 for what has the form of
    a word. Other candidates stay without a label. At most ``LABELLED`` of each kind, by hash.
    """
    found = docs.select(F.explode(candidates(text_or_empty("text"), F.coalesce("source", F.lit("")), dictionary)).alias("f")).select("f.*")
    y = F.when(F.col("candidate").rlike("^AKIA[0-9A-Z]{16}$"), 1.0)
    y = y.when((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0.15), 1.0)
    y = y.when(F.col("candidate").rlike("^([A-Z]?[a-z]+|[A-Z]+)$") & (F.col("named") == 0), 0.0)
    known = found.withColumn("y", y)
    kind = lambda v: known.where(F.col("y") == v).orderBy(F.xxhash64("candidate"), "candidate", "start").limit(LABELLED)
    return kind(1.0).union(kind(0.0)).select("y", *FEATURES)


def _tree(lines: list[tuple[int, str]], x: Column) -> Column:
    """A tree as Spark prints it (depth and text of each line) as a column."""
    depth, line = lines[0]
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1]))
    feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    other = next(i for i in range(1, len(lines)) if lines[i][0] == depth)
    return F.when(x[FEATURES[int(feature)]] <= float(limit), _tree(lines[1:other], x)).otherwise(_tree(lines[other + 1 :], x))


def forest_score(model: RandomForestClassificationModel, x: Column) -> Column:
    """The share of trees that call a candidate a secret."""
    trees = []
    for tree in model.trees:
        lines = [(len(s) - len(s.lstrip()), s.strip()) for s in tree.toDebugString.splitlines()[1:] if s.strip()]
        trees.append(_tree(lines, x))
    return reduce(lambda a, b: a + b, trees) / F.lit(float(len(trees)))


def train(labelled: DataFrame) -> RandomForestClassificationModel | float:
    """A forest, or the one label there is; 1.0, that is every candidate stays, without any."""
    labelled = stage(labelled.select("y", *FEATURES), "labelled-findings")
    kinds = [r.y for r in labelled.select("y").distinct().orderBy("y").collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 1.0
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(labelled).select("y", "x")
    # One partition of a bounded sample: the forest is the same wherever it is trained.
    return RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=5).fit(rows.coalesce(1))


def with_findings(docs: DataFrame, labelled: DataFrame | None = None, out: str = "findings") -> DataFrame:
    """``docs`` with an array ``out`` (``candidate, start, n_chars, score``) of the secrets in ``text``.

    Null and empty texts have none; a null ``source`` is an empty path. Each place of a candidate is judged by what stands
    beside it; where one is a secret, all places of it in the text are findings, each with its own score. ``labelled`` holds findings with a label ``y`` and the features; without it they are labelled by form.
    Repeated rows, null ids and other columns stay as they are.
    """
    dictionary = dictionary_of(docs)
    model = train(labelled_by_form(docs, dictionary) if labelled is None else labelled)
    score = lambda x: F.lit(model) if isinstance(model, float) else forest_score(model, x)
    scored = F.transform(
        candidates(text_or_empty("text"), F.coalesce("source", F.lit("")), dictionary),
        lambda x: F.struct(x["candidate"].alias("candidate"), x["start"].alias("start"), x["chars"].cast("bigint").alias("n_chars"), score(x).alias("score")),
    )
    names = lambda places: F.array_distinct(F.transform(F.filter(places, lambda f: f["score"] >= THRESHOLD), lambda f: f["candidate"]))
    every = lambda places: let(names(places), lambda known: F.filter(places, lambda f: F.array_contains(known, f["candidate"])))
    return docs.withColumn(out, let(scored, every))


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with each secret of ``text`` replaced; texts without any, and all other columns, as they were."""
    columns, found = docs.columns, free_name(docs, "findings")
    # Long ones first: a secret within another one would leave the other's rest.
    by_length = F.array_sort(F.array_distinct(F.transform(found, lambda f: F.struct((-f["n_chars"]).alias("k"), f["candidate"].alias("candidate")))))
    clean = F.aggregate(by_length, F.col("text"), lambda text, f: F.replace(text, f["candidate"], F.lit(MASK)))
    return with_findings(docs, labelled, found).select(*[clean.alias(c) if c == "text" else F.col(c) for c in columns])


def _rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.explode("findings").alias("f")).select(
        "doc_id", "f.start", "f.n_chars", F.sha2("f.candidate", 256).alias("secret_sha256"), "f.score"
    )


def secret_spans(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, n_chars, secret_sha256, score``: a row for each place of each secret of each row of ``docs``."""
    return _rows(with_findings(docs.select("doc_id", "text", "source"), labelled))


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """As ``secret_spans``, but one row for each secret of each row of ``docs``, that of its first place."""
    found = with_findings(docs.select("doc_id", "text", "source"), labelled)
    first = lambda names: F.filter("findings", lambda f, i: F.array_position(names, f["candidate"]) == i + 1)
    return _rows(found.withColumn("findings", let(F.transform("findings", lambda f: f["candidate"]), first)))
