"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words character by character: one counts the words of toxic, one those of ordinary
labelled texts.  Each has its own counts of the longest n-grams only; both discount them and back
off to the same shorter n-grams, whose continuation counts come from every document, labelled or
not.  So an expression that neither class has shown scores alike in both.

A word's log-likelihood ratio is the sum of its characters' ratios.  Toxic texts are mostly ordinary:
their words are taken from the toxic model with a small share and from the ordinary one otherwise.
The mean log-likelihood ratio a word of both kinds of text, and the length, give the score by a
logistic function that is fitted on labelled rows of which no word was counted.

Counting and the shared probabilities are Spark tables that grow with the corpus.  The table of ratios
is broadcast while it has a bounded number of rows; beyond, words meet it by joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.llm.common import class_labels, hash_sample
from storyspark.session import cut_lineage

#: Characters of the longest n-gram, and the discount of every count.
ORDER, DISCOUNT = 5, 0.75
#: Share of the words of a toxic text that come from the toxic model.
SHARE = 0.002
#: Characters of a word: a longer run counts as several words.
LONGEST = 64
#: Rows of the ratio table, and of labels, up to which they are broadcast.
MODEL_ROWS, LABEL_ROWS = 1_000_000, 2_000_000
#: Distinct words that a task counts before it passes them on.
TASK_WORDS = 200_000
#: Labelled rows that fit the logistic function, at most.
FIT_ROWS = 8000
#: Everything in ASCII but letters and digits separates words; "^" and "$" can so mark their ends.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """Lower-case words of a text, of at most LONGEST characters each."""
    found = (text or "").lower().encode().translate(_FOLD).decode().split(" ")
    if max(map(len, found)) <= LONGEST:
        return [w for w in found if w]
    return [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def grams(word: str, order: int) -> list[str]:
    """The n-gram that ends in each character of a word, and in its end mark; shorter ones start with the word."""
    marked = f"^{word}$"
    return [marked[max(0, i - order + 1):i + 1] for i in range(1, len(marked))]


def _bucket(id_: Column, n: int) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % n


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is held out too."""
    return F.coalesce(_bucket(doc_id, 4) == 2, F.lit(True))


def _fits(doc_id: Column) -> Column:
    """Labelled rows that fit the logistic function, and whose words are not counted: a fifth."""
    return F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 4) % 5 == 0


@dataclass
class Model:
    """``seen`` maps n-grams to their log ratio, ``contexts`` what stands before an unseen character to its log ratio."""

    order: int
    table: DataFrame | None = None  # (gram, seen, ratio)
    ratios: tuple[dict[str, float], dict[str, float]] | None = None  # the same, while it is small
    weights: np.ndarray | None = None  # of 1, evidence and length
    base: float = 0.0  # share of toxic rows: the score where nothing can be learned


def word_ratio(word: str, order: int, seen: dict[str, float], contexts: dict[str, float]) -> float:
    total = 0.0
    for gram in grams(word, order):
        ratio = seen.get(gram)
        total += contexts.get(gram[:-1], 0.0) if ratio is None else ratio
    return total


def mixed(ratio):
    """Log ratio of a word in a toxic text and in an ordinary one, from its log ratio in the two models, less its least value."""
    return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + ratio) - np.log1p(-SHARE)


# ---- counting

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, ordinary) of (text, label): every word, with its occurrences in the rows labelled 1 and 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        counts = Counter(), Counter()

        def emit() -> pa.RecordBatch:
            every = sorted(known)
            columns = [pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in (counts[1], counts[0]))]
            known.clear()
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "toxic", "ordinary"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = words(text.as_py())
                known.update(found)
                if label is not None:
                    counts[label].update(found)
                if len(known) > TASK_WORDS:
                    yield emit()
        yield emit()

    partial = docs.select("text", "label").mapInArrow(run, "word string, toxic long, ordinary long")
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def gram_counts(counted: DataFrame, order: int) -> DataFrame:
    """(gram, toxic, ordinary, types) of the n-grams of ``order`` and the shorter ones that start a word; ``types`` counts words."""
    each = F.expr(f"explode(transform(sequence(2, length(marked)), i -> substring(marked, greatest(i - {order - 1}, 1), least({order}, i))))")
    return (counted.withColumn("marked", F.concat(F.lit("^"), "word", F.lit("$"))).select(each.alias("gram"), "toxic", "ordinary")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("types")))


def _length(n: int) -> Column:
    return F.length("gram") == n


def _context(column: str = "gram") -> Column:
    return F.expr(f"substring({column}, 1, length({column}) - 1)")


def shared_probabilities(top: DataFrame, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(gram, p) of all n-grams shorter than ``order``, by Kneser-Ney over the whole corpus.

    An n-gram counts the characters that precede it somewhere; one that starts a word counts words.
    """
    levels = {}
    longer = top.where(_length(order)).select("gram")
    for n in range(order - 1, 0, -1):
        inner = longer.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels[n] = cut_lineage(inner.unionByName(top.where(_length(n)).select("gram", F.col("types").alias("n"))))
        longer = levels[n].select("gram")
    # a context has as many rows as characters follow it: these groups are bounded by the alphabet
    around = Window.partitionBy("context")
    below = None
    every = None
    for n in range(1, order):
        here = levels[n].withColumn("context", _context()).select("gram", "n", F.sum("n").over(around).alias("total"), F.count("*").over(around).alias("kinds"))
        if below is None:  # characters alone back off to a uniform choice, with one more for what never occurred
            lower = here.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            lower = here.withColumn("suffix", F.expr("substring(gram, 2)")).join(below.withColumnsRenamed({"gram": "suffix", "p": "lower"}), "suffix")
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("lower")) / F.col("total")
        below = cut_lineage(lower.select("gram", p.alias("p")))
        every = below if every is None else every.unionByName(below)
    return every


def ratio_table(counted: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, seen, ratio): log ratio of the two models, toxic over ordinary, of the n-grams that a class has, and of what follows a context otherwise."""
    top = cut_lineage(gram_counts(counted, order))
    shared = shared_probabilities(top, order, discount)
    around = Window.partitionBy("context")
    own = top.where("toxic + ordinary > 0").withColumn("context", _context())
    for c in ("toxic", "ordinary"):
        own = own.withColumn(f"{c}_total", F.sum(c).over(around)).withColumn(f"{c}_kinds", F.count_if(F.col(c) > 0).over(around))
    own = cut_lineage(own)
    placed = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(shared.withColumnRenamed("gram", "suffix"), "suffix")

    def probability(c: str) -> Column:
        count, total, kinds = F.col(c), F.col(f"{c}_total"), F.col(f"{c}_kinds")
        return F.when(total > 0, (F.greatest(count - discount, F.lit(0.0)) + discount * kinds * F.col("p")) / total).otherwise(F.col("p"))

    def left_over(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, F.log(discount * F.col(f"{c}_kinds") / F.col(f"{c}_total"))).otherwise(0.0)

    seen = placed.select("gram", F.lit(True).alias("seen"), (F.log(probability("toxic")) - F.log(probability("ordinary"))).alias("ratio"))
    contexts = own.dropDuplicates(["context"]).select(F.col("context").alias("gram"), F.lit(False).alias("seen"),
                                                      (left_over("toxic") - left_over("ordinary")).alias("ratio"))
    return cut_lineage(seen.unionByName(contexts))


# ---- scoring

def _evidence(docs: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """``docs`` (text and the columns of ``keep``) with ``evidence`` (sum over its words) and ``n_words`` instead of the text."""
    if model.ratios is not None:
        shared, order = docs.sparkSession.sparkContext.broadcast(model.ratios), model.order

        @F.pandas_udf("evidence double, n_words long")
        def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known: dict[str, float] = {}
            for batch in texts:
                found = []
                for text in batch:
                    each = words(text)
                    if len(known) > TASK_WORDS:
                        known.clear()
                    for w in set(each).difference(known):
                        known[w] = float(mixed(word_ratio(w, order, *shared.value)))
                    # in the order of the words: the same text gives the same sum everywhere
                    found.append((float(np.fromiter(map(known.__getitem__, each), float, len(each)).sum()), len(each)))
                yield pd.DataFrame(found, columns=["evidence", "n_words"])

        return docs.withColumn("read", read("text")).select(*keep, "read.evidence", "read.n_words")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, word, n = [], [], []
            for i, text in enumerate(batch.column(1)):
                for w, c in Counter(words(text.as_py())).items():
                    at.append(i)
                    word.append(w)
                    n.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["row", "word", "n"])

    # rows of one text are alike, so the text's digest is the key
    docs = docs.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256))
    pairs = cut_lineage(docs.dropDuplicates(["row"]).select("row", "text").mapInArrow(counted, "row string, word string, n long"))
    each = F.expr(f"explode(transform(sequence(2, length(marked)), i -> substring(marked, greatest(i - {model.order - 1}, 1), least({model.order}, i))))")
    spelled = pairs.select("word").distinct().withColumn("marked", F.concat(F.lit("^"), "word", F.lit("$"))).select("word", each.alias("gram"))
    seen = model.table.where("seen").select("gram", F.col("ratio").alias("own"))
    contexts = model.table.where("NOT seen").select(F.col("gram").alias("context"), F.col("ratio").alias("other"))
    ratios = (spelled.join(seen, "gram", "left").withColumn("context", _context()).join(contexts, "context", "left")
              .groupBy("word").agg(F.sum(F.coalesce("own", "other", F.lit(0.0))).alias("ratio")))
    least = float(np.log1p(-SHARE))
    # log(1 + share / (1 - share) e^ratio), without overflow
    x = F.col("ratio") + float(np.log(SHARE) - least)
    value = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    values = cut_lineage(ratios.select("word", value.alias("value")))
    sums = cut_lineage(pairs.join(values, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("evidence"), F.sum("n").alias("n_words")))
    return docs.select(*keep, "row").join(sums, "row", "left").select(*keep, F.coalesce("evidence", F.lit(0.0)).alias("evidence"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


def _inputs() -> list[Column]:
    """Of the logistic function: log evidence a word, log words."""
    mean = F.when(F.col("n_words") > 0, F.col("evidence") / F.col("n_words")).otherwise(0.0)
    return [F.log(mean + 1e-4).alias("x"), F.log1p(F.col("n_words").cast("double")).alias("length")]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of 1 and the columns of ``x``, by Newton's method on the log loss with a small ridge."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        change = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
        b += change
        if np.abs(change).max() < 1e-9:
            break
    slopes = b[1:] / spread
    return np.r_[b[0] - (slopes * mean).sum(), slopes]


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
        model_rows: int = MODEL_ROWS, label_rows: int = LABEL_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Both models and the logistic function over them.

    All labelled rows that are not held out are learned from: the words of four fifths of them are
    counted, and the others (the ``fit_rows`` of least hash, at most) fit the logistic function.
    Shared counts come from all documents.  Labels are broadcast up to ``label_rows`` rows, ratios up
    to ``model_rows``: beyond, both are joined, with the same result.
    """
    known = cut_lineage(class_labels(labels, target).where(~held_out(F.col("doc_id"))))
    sizes = {(r["fits"], r["label"]): r["count"] for r in known.groupBy(_fits(F.col("doc_id")).alias("fits"), "label").count().collect()}
    total = sum(sizes.values())
    base = sum(n for (_, label), n in sizes.items() if label == 1) / total if total else 0.0
    if len(sizes) < 4:
        return Model(order, base=base)
    small = F.broadcast if total <= label_rows else lambda df: df
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    counting = known.where(~_fits(F.col("doc_id")))
    counted = cut_lineage(word_counts(slim.join(small(counting), "doc_id", "left")))
    table = ratio_table(counted, order)
    model = Model(order, table, base=base)
    if table.count() <= model_rows:
        rows = table.toArrow()
        sides = {True: {}, False: {}}
        for gram, seen, ratio in zip(*(rows.column(c).to_pylist() for c in ("gram", "seen", "ratio"))):
            sides[seen][gram] = ratio
        model.ratios = sides[True], sides[False]
    wanted = hash_sample(known.where(_fits(F.col("doc_id"))), fit_rows, ["doc_id"])
    sample = _evidence(slim.join(F.broadcast(wanted), "doc_id"), model, ["doc_id", "label"]).select("doc_id", "label", *_inputs())
    got = hash_sample(sample, fit_rows, ["doc_id", "x", "length"]).orderBy("doc_id", "x", "length").toPandas()
    if got["label"].nunique() == 2:
        model.weights = logistic(got[["x", "length"]].to_numpy(), got["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted, n_words, evidence) per row.

    ``score`` is the probability that a text is toxic, from its words alone; ``predicted`` is 1 from
    ``threshold`` on; ``evidence`` is the log-likelihood ratio a word.  A null or empty text has no
    word and so the least evidence; where the labels do not hold both classes every score is the share of
    toxic rows among them (0 without any).  Repeated rows score alike, a null id counts as held out, very
    long texts are read whole, an empty table gives an empty one; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model.weights is None:
        found = slim.select("id", F.lit(0.0).alias("evidence"), F.lit(0).alias("n_words"))
        value = F.lit(float(model.base))
    else:
        found = _evidence(slim, model, ["id"])
        x, length = _inputs()
        one, slope, more = (float(w) for w in model.weights)
        value = 1 / (1 + F.exp(-(one + slope * x + more * length)))
    scored = found.select("id", held_out(F.col("id")).alias("held_out"), value.alias("score"), F.col("n_words").cast("long").alias("n_words"),
                          F.when(F.col("n_words") > 0, F.col("evidence") / F.col("n_words")).otherwise(0.0).alias("evidence"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "evidence")
