"""Toxicity by the nearest labelled examples, found by exact TF-IDF cosine.

1. Labels meet documents as (key, hash of the text), so texts need not move; equal texts
   are one example. Per class up to ``EXAMPLES`` examples are drawn by their hash, and
   weighed so that the classes keep the shares they have among all labelled texts.
2. Terms are words and beginnings of words that labels depend on: a likelihood-ratio test
   over the examples, at a level divided by the number of terms tested. What two texts
   share otherwise does not make them alike in what the label marks, so all words together
   are one term more, present everywhere: it holds the rest of the vector, and a sign in
   a long text counts less than in a short one. Weights are the square root of a term's
   count times its inverse document frequency, counted over all documents.
3. An inverted index holds the examples' unit vectors. Postings come in blocks of
   ``BLOCK`` examples with the greatest weight of the term in the block. A search adds
   these up to bounds of the blocks, scores the most promising blocks, and then all others
   whose bound reaches the k-th best cosine: the k nearest are exact.
4. Neighbours vote by their closeness. What a vote is worth is measured on the examples,
   each without itself: shares of toxic ones per bin of votes, made monotone.

Collected are the terms, at most ``2 * EXAMPLES`` vectors over them, and the bins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage, id_text, ship

#: Labelled texts of a class that the classifier is fitted on, at most.
EXAMPLES = 4_096
NEIGHBOURS = 15
BLOCK = 64
#: Blocks scored before the bounds are compared with the k-th best.
FIRST_BLOCKS = 4
LEVEL = 0.01
BINS = 10
#: Searches that a task remembers.
REMEMBERED = 50_000

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of a word that are terms beside the word.
BEGINNINGS = range(2, 7)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall((text or "").lower())


def forms(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in BEGINNINGS if k < len(word))]


class Terms:
    """Numbers of the terms; 0 stands for all words."""

    def __init__(self, terms: list[str]) -> None:
        self.number = {t: k for k, t in enumerate(terms, 1)}
        self.first = {t[: BEGINNINGS[0]] for t in terms}

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each term occurs in a text, by number."""
        found = Counter(words_of(text))
        if not found:
            return {}
        out = {0: found.total()}
        # Most words begin like no term.
        first, end = self.first, BEGINNINGS[0]
        for word in [w for w in found if w[:end] in first]:
            for form in forms(word):
                if form in self.number:
                    t = self.number[form]
                    out[t] = out.get(t, 0) + found[word]
        return dict(sorted(out.items()))


@dataclass
class Index:
    """Block-max inverted index over unit vectors; vector numbers break ties."""

    numbers: np.ndarray  # per row, the number of its vector
    rows: np.ndarray  # postings by term, then by row
    weights: np.ndarray
    places: np.ndarray  # per term and block, where the postings begin
    tops: np.ndarray  # per term and block, the greatest weight

    @classmethod
    def build(cls, vectors: list[dict[int, float]], terms: int) -> Index:
        # Rows of one heaviest term, term 0 aside, share blocks, so that bounds are tight.
        def kind(k: int) -> tuple:
            heaviest = max(((w, t) for t, w in vectors[k].items() if t), default=(0.0, 0))
            return heaviest[1], heaviest[0], k

        numbers = sorted(range(len(vectors)), key=kind)
        entries = [(t, row, w) for row, k in enumerate(numbers) for t, w in vectors[k].items()]
        term, rows, weights = (np.array(c) for c in zip(*entries)) if entries else (np.zeros(0, int),) * 3
        order = np.lexsort((rows, term))
        term, rows, weights = term[order], rows[order], weights[order].astype(float)
        blocks = -(-len(vectors) // BLOCK)
        cell = term * blocks + rows // BLOCK
        places = np.searchsorted(cell, np.arange(terms * blocks + 1))
        tops = np.zeros(terms * blocks)
        np.maximum.at(tops, cell, weights)
        ends = np.column_stack([places[:-1].reshape(terms, blocks), places[1:].reshape(terms, blocks)[:, -1:]])
        return cls(np.array(numbers, np.int64), rows, weights, ends, tops.reshape(terms, blocks))

    def nearest(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the ``k`` vectors of the greatest cosine above 0, in order, and their cosines."""
        terms, own = np.array(list(vector.keys()), int), np.array(list(vector.values()))
        bounds = own @ self.tops[terms]
        order = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds)]
        cosines = np.zeros(len(bounds) * BLOCK)
        first = self._scored(terms, own, order[:FIRST_BLOCKS], cosines, k)
        least = first[1][-1] if len(first[0]) == k else 0.0
        # Sums in another order differ by rounding, and vectors that tie may have smaller numbers.
        left = order[FIRST_BLOCKS:]
        left = left[bounds[left] >= least - 1e-9]
        return self._scored(terms, own, left, cosines, k) if len(left) else first

    def _scored(self, terms: np.ndarray, own: np.ndarray, blocks: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Add the cosines of the rows of some blocks; the best of all rows scored."""
        begin = self.places[terms[:, None], blocks].ravel()
        length = self.places[terms[:, None], blocks + 1].ravel() - begin
        at = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        weight = self.weights[at] * np.repeat(np.repeat(own, len(blocks)), length)
        cosines += np.bincount(self.rows[at], weight, len(cosines))
        rows = np.flatnonzero(cosines)
        found = cosines[rows]
        if len(rows) > k:
            kept = found >= np.partition(found, len(rows) - k)[len(rows) - k]
            rows, found = rows[kept], found[kept]
        numbers = self.numbers[rows]
        best = np.lexsort((numbers, -found))[:k]
        return numbers[best], found[best]


@dataclass
class Model:
    """What scores texts; small, and sent to every task."""

    terms: Terms
    idf: list[float]
    index: Index
    names: list[str | None]
    shares: np.ndarray  # per example, the share of its labels that are toxic
    weights: np.ndarray  # per example, how many labelled texts it stands for
    levels: list[float]  # calibrated scores per bin of votes, the last without neighbours

    def vote(self, vector: dict[int, float], without: int | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Share of the neighbours' weight that is toxic (None without any), and the neighbours."""
        rows, cosines = self.index.nearest(vector, NEIGHBOURS + (without is not None)) if vector else (np.zeros(0, int), np.zeros(0))
        if without is not None:
            kept = rows != without
            rows, cosines = rows[kept][:NEIGHBOURS], cosines[kept][:NEIGHBOURS]
        if not len(rows):
            return None, rows, cosines
        weight = self.weights[rows] / (1.01 - np.minimum(cosines, 1.0))
        return float((weight * self.shares[rows]).sum() / weight.sum()), rows, cosines


def weighed(counts: dict[int, int], idf: list[float]) -> dict[int, float]:
    """The unit vector of a text."""
    return unit({t: math.sqrt(n) * idf[t] for t, n in counts.items()})


def unit(vector: dict[int, float]) -> dict[int, float]:
    length = math.sqrt(sum(w * w for w in vector.values()))
    return {t: w / length for t, w in vector.items()}


def bin_of(vote: float | None) -> int:
    return BINS if vote is None else min(BINS - 1, int(vote * BINS))


def monotone(toxic: list[float], total: list[float]) -> list[float]:
    """Shares per bin that never fall; each bin starts with the share of all, as one example."""
    base = (sum(toxic) + 0.5) / (sum(total) + 1)
    pools: list[list[float]] = []
    for y, n in zip(toxic[:BINS], total[:BINS]):
        pools.append([y + base, n + 1, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2] + k]
    levels = [y / n for y, n, k in pools for _ in range(int(k))]
    return [*levels, (toxic[BINS] + base) / (total[BINS] + 1)]


def draw_examples(docs: DataFrame, labels: DataFrame, stage: Stage, key: str, text: str, label: str, bound: int) -> DataFrame:
    """(name, text, share, weight): distinct labelled texts, up to ``bound`` of each class.

    A document's label is the greatest of its rows, null ones and null keys left out. A
    text is toxic if at least half of the documents that hold it are.
    """
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    hashed = F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")
    facts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), *hashed).join(marks, "key")
    facts = facts.groupBy("h", "g").agg(F.min("key").alias("key"), F.avg("toxic").alias("share"))
    facts = stage.keep(facts.withColumn("class", F.col("share") >= 0.5), "labelled")
    sizes = {r["class"]: r["count"] for r in facts.groupBy("class").count().collect()}
    chosen = None
    for kind, n in sizes.items():
        # Hashes are even: those below the limit are a few more than wanted.
        most = 1.0 if n <= bound else min(1.0, 1.2 * bound / n + 50 / n)
        some = facts.filter((F.col("class") == kind) & (F.pmod("g", F.lit(1 << 40)) <= int(most * (1 << 40)))).orderBy("g", "h").limit(bound)
        some = some.withColumn("weight", F.lit(n / min(n, bound)))
        chosen = some if chosen is None else chosen.unionAll(some)
    if chosen is None:
        chosen = facts.withColumn("weight", F.lit(1.0))
    chosen = stage.keep(chosen.drop("class"), "chosen")
    # At most ``bound`` rows a class.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *hashed).join(F.broadcast(chosen), ["key", "h", "g"])
    rows = rows.groupBy("h", "g").agg(*(F.any_value(c).alias(c) for c in ("key", "text", "share", "weight")))
    return stage.keep(rows.select(id_text("key").alias("name"), "text", "share", "weight"), "examples")


def _counted(rows: DataFrame, terms: Terms | None) -> DataFrame:
    """(word, toxic, clean) documents that hold each term, all or those given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter[str](), Counter[str]())
        names = ["", *terms.number] if terms else []
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                if terms is None:
                    held[toxic].update({f for w in set(words_of(text.as_py())) for f in forms(w)})
                else:
                    held[toxic].update(names[t] for t in terms.counts(text.as_py()))
                if len(held[0]) + len(held[1]) > 500_000:
                    yield from listed(held)
        yield from listed(held)

    def listed(held: tuple[Counter[str], Counter[str]]) -> Iterator[pa.RecordBatch]:
        for kind, words in enumerate(held):
            n = pa.array(list(words.values()), pa.int64())
            none = pa.array([0] * len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), n if kind else none, none if kind else n], ["word", "toxic", "clean"])
            words.clear()

    counts = rows.mapInArrow(run, "word string, toxic long, clean long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def least_ratio(tests: int, level: float = LEVEL) -> float:
    """The likelihood ratio (one degree of freedom) that chance exceeds in ``level`` of all ``tests``."""
    low, high = 0.0, 2_000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > level / max(1, tests) else (low, mid)
    return high


def _telling(examples: DataFrame, stage: Stage) -> list[str]:
    """Terms whose presence in an example depends on its class."""
    totals = examples.agg(F.sum((F.col("share") >= 0.5).cast("long")).alias("t"), F.count("*").alias("n")).first()
    t, c = totals.t or 0, totals.n - (totals.t or 0)
    if not t or not c:
        return []
    counts = stage.keep(_counted(examples.select("text", (F.col("share") >= 0.5).alias("toxic")), None), "words")
    held = F.col("toxic") + F.col("clean")

    def part(seen, total: int, all_seen):
        expected = total * all_seen / F.lit(t + c)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (
        part(F.col("toxic"), t, held)
        + part(F.col("clean"), c, held)
        + part(t - F.col("toxic"), t, t + c - held)
        + part(c - F.col("clean"), c, t + c - held)
    )
    limit = least_ratio(counts.filter(held > 1).count())
    found = counts.filter((held > 1) & (ratio >= limit)).select("word", ratio.alias("ratio")).collect()
    return most_telling({r.word: r.ratio for r in found})


def most_telling(ratios: dict[str, float]) -> list[str]:
    """Terms without those that say the same less clearly.

    Of a word and its beginnings the one with the greatest ratio stays, of equals the longest.
    """
    kept: set[str] = set()
    within: set[str] = set()  # beginnings of the kept
    for term in sorted(ratios, key=lambda t: (-round(ratios[t], 6), -len(t.rstrip("-")), t)):
        shorter = [term, *forms(term.rstrip("-"))[1:]]
        if term not in within and not kept.intersection(shorter):
            kept.add(term)
            within.update(shorter)
    return sorted(kept)


def fit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES
) -> Model:
    """Learn from the labelled documents; term counts come from all ``docs``."""
    spark = docs.sparkSession
    stage = Stage(spark, "toxicity")
    drawn = draw_examples(docs, labels, stage, key, text, label, examples)
    words = _telling(drawn, stage)
    terms = Terms(words)
    every = docs.select(F.col(text).alias("text"), F.lit(False).alias("toxic"))
    held = {r.word: r.clean for r in _counted(every, terms).collect()}
    n = docs.count()
    idf = [math.log((1 + n) / (1 + held.get(w, 0))) + 1 for w in ["", *words]]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms.counts(t.as_py()) for t in batch.column(1)]
            lists = [pa.array([list(f.keys()) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2), batch.column(3)], ["name", "terms", "counts", "share", "weight"])

    vectors = drawn.select("name", "text", "share", "weight").mapInArrow(
        counted, "name string, terms array<int>, counts array<long>, share double, weight double"
    )
    # One row per example, with its terms only.
    rows = sorted(vectors.collect(), key=lambda r: (r.name, r.share))
    own = [weighed(dict(zip(r.terms, r.counts)), idf) for r in rows]
    model = Model(
        terms,
        idf,
        Index.build(own, len(idf)),
        [r.name for r in rows],
        np.array([r.share for r in rows], float),
        np.array([r.weight for r in rows], float),
        [],
    )
    model.levels = _calibrated(spark, model, own)
    return model


def _calibrated(spark, model: Model, vectors: list[dict[int, float]]) -> list[float]:
    """Scores per bin of votes, from the votes on each example of all the others."""
    toxic, total = [0.0] * (BINS + 1), [0.0] * (BINS + 1)
    if vectors:
        sent = spark.sparkContext.broadcast((model, vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted, own = sent.value
            for batch in batches:
                rows = batch.column(0).to_pylist()
                bins = [bin_of(fitted.vote(own[k], without=k)[0]) for k in rows]
                weights = fitted.weights[rows]
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(weights * fitted.shares[rows]), pa.array(weights)], ["bin", "toxic", "total"])

        found = spark.range(len(vectors)).mapInArrow(run, "bin long, toxic double, total double")
        for r in found.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total")).collect():
            toxic[r.bin], total[r.bin] = r.toxic, r.total
    return monotone(toxic, total)


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7, shown: int = 3) -> DataFrame:
    """Add ``score``, ``predicted`` and ``evidence`` to every row.

    ``score`` is the calibrated share of toxic texts among those with such neighbours, 0 to
    1. Texts that are null or hold no letter have no neighbours and get the share among such
    examples; without any labels all scores are 0.5. ``evidence`` lists the ``shown``
    nearest examples (name, cosine, share of toxic labels). Columns of these names are replaced.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score double, evidence array<struct<example string, cosine double, toxic double>>>")
    def scored(column: pa.Array) -> pa.Array:
        fitted: Model = sent.value
        known: dict[tuple | bool, dict] = {}
        out = []
        for value in column:
            counts = fitted.terms.counts(value.as_py())
            # Only proportions matter to a unit vector, so texts without a sign are one search.
            found = tuple(counts.items()) if len(counts) > 1 else bool(counts)
            if found not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                vote, rows, cosines = fitted.vote(weighed(counts, fitted.idf))
                near = [
                    {"example": fitted.names[r], "cosine": float(c), "toxic": float(fitted.shares[r])}
                    for r, c in zip(rows[:shown].tolist(), cosines[:shown].tolist())
                ]
                known[found] = {"score": fitted.levels[bin_of(vote)], "evidence": near}
            out.append(known[found])
        kind = pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("toxic", pa.float64())])
        return pa.array(out, pa.struct([("score", pa.float64()), ("evidence", pa.list_(kind))]))

    made = ("score", "predicted", "evidence")
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept, scored(text).alias("_scored"))
    return rows.select(
        *kept, F.col("_scored.score").alias("score"), (F.col("_scored.score") >= least).cast("int").alias("predicted"), F.col("_scored.evidence").alias("evidence")
    )
