"""A hidden Markov language model, trained by Baum-Welch over all training rows.

Words are what stands between the six ASCII white-space characters, A-Z lower-cased;
a text is its words and one end. The model emits symbols: each word that training rows
hold at least ``OFTEN`` times, the end, or a class of rare words, named by a hash of
their last three bytes. A rare word's probability is that of its class times its
share ``(c + 0.1) / (C + 0.1 * (V + 1))`` of the class, one slot of which is kept for
words never seen. So the words of a text have a proper probability under the model.

What grows with the corpus stays on the executors. Texts are numbered word by word
within parts of about ``PART`` words; counts, expected counts and emissions are tables
in slabs of about ``SLAB_WORDS`` words. In each round a part gets the emissions of the
words it holds, and gives back their expected counts, which are added per slab. The
driver holds what belongs to the end, the classes and the states.

Texts of similar length are walked side by side, one word per step, with scaled
forward and backward values; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Stage, with_row_key

OFTEN = 3  # a word counted less in training is rare
CLASSES = 2_048
STATES = 8
ROUNDS = 4
ADD = 0.1
FLOOR = 1e-9
PART, BLOCK = 6_000_000, 1_000_000  # words numbered together, and words walked at once
SLABS, SLAB_WORDS = 64, 10_000
END = b"\n"  # no word holds white space
PIECE = "part long, slab int, idx binary, data binary"
SUMS = "slab int, c binary, emitted binary, sums binary"


def words(text: bytes | None) -> list[bytes]:
    """ASCII white space cuts, and only A-Z are lowered: what ``bytes`` does."""
    return text.lower().split() if text else []


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes, compressed without loss: first all their first bytes, and so on."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 4).T.tobytes()
    return numbers.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(kind).ravel()


def _texts(batch: pa.RecordBatch, column: str = "_text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


class Numbers(dict):
    """Words numbered as they come; the end is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode(df: DataFrame) -> DataFrame:
    """Replace ``_text`` by its words' numbers in its part.

    Behind the rows of a part, which is named by its first ``_row``, comes a row
    with the part's words and how often its rows with ``_trained`` hold each.
    """
    extra = [f for f in df.schema.fields if f.name != "_text"]
    schema = T.StructType(
        [
            *(T.StructField(f.name, f.dataType) for f in extra),
            T.StructField("part", T.LongType()),
            T.StructField("symbols", T.BinaryType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("seen", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, part, held = Numbers({END: 0}), None, 0
        seen = np.zeros(0, np.int64)
        names = [f.name for f in schema.fields]
        lists = [pa.list_(pa.binary()), pa.list_(pa.int64())]

        def some(batch: pa.RecordBatch, symbols: list[bytes]) -> pa.RecordBatch:
            n = len(symbols)
            own = [pa.array([part] * n, pa.int64()), pa.array(symbols, pa.binary()), *(pa.nulls(n, k) for k in lists)]
            return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in extra), *own], names)

        def told(kinds: list[pa.DataType]) -> pa.RecordBatch:
            full = np.zeros(len(numbers), np.int64)
            full[: len(seen)] = seen
            own = [pa.array([part], pa.int64()), pa.nulls(1, pa.binary()), pa.array([list(numbers)], lists[0]), pa.array([full], lists[1])]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), *own], names)

        for batch in batches:
            keys, learned = batch.column("_row").to_pylist(), batch.column("_trained").to_pylist()
            kinds = [batch.schema.field(f.name).type for f in extra]
            symbols: list[bytes] = []
            counted: list[np.ndarray] = []
            begin = 0

            def count() -> np.ndarray:
                if not counted:
                    return seen
                now = np.bincount(np.concatenate(counted), minlength=len(seen))
                now[: len(seen)] += seen
                counted.clear()
                return now

            for at, text in enumerate(_texts(batch)):
                if part is None:
                    part = keys[at]
                found = words(text)
                ids = np.zeros(len(found) + 1, np.int32)
                ids[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                symbols.append(pack(ids))
                if learned[at]:
                    counted.append(ids)
                held += len(ids)
                if held >= PART:
                    seen = count()
                    yield some(batch.slice(begin, len(symbols)), symbols)
                    yield told(kinds)
                    begin, symbols = at + 1, []
                    numbers, part, held = Numbers({END: 0}), None, 0
                    seen = np.zeros(0, np.int64)
            if symbols:
                seen = count()
                yield some(batch.slice(begin, len(symbols)), symbols)
        if part is not None:
            yield told(kinds)

    return df.mapInArrow(run, schema)


def listed_words(encoded: DataFrame) -> DataFrame:
    """(part, pos, word, seen) from the rows that tell the words of a part."""
    told = encoded.filter(F.col("words").isNotNull())
    both = told.select("part", F.posexplode(F.arrays_zip("words", "seen")).alias("pos", "w"))
    return both.select("part", "pos", F.col("w.words").alias("word"), F.col("w.seen").alias("seen"))


def training_counts(encoded: DataFrame) -> DataFrame:
    return listed_words(encoded).filter("seen > 0").groupBy("word").agg(F.sum("seen").alias("c"))


def word_counts(df: DataFrame) -> DataFrame:
    """(word, c) over the column ``_text``; each text's end counts as a word."""
    return training_counts(encode(with_row_key(df.select("_text", F.lit(True).alias("_trained")), "_row")))


@dataclass
class Vocabulary:
    """Totals, the end and the classes, and the table of counts; symbol 0 is the end."""

    table: DataFrame
    counts: np.ndarray  # end, classes
    distinct: np.ndarray  # per class, words of it in training
    n_frequent: int
    tokens: int
    size: int
    cut: int  # words counted at least as often are frequent
    end: int = 0

    @property
    def words(self) -> DataFrame:
        """(word, c) of the words with emissions of their own."""
        return self.table.filter((F.col("c") >= self.cut) & (F.col("word") != F.lit(END)))

    @property
    def frequent(self) -> dict[bytes, int]:
        """Those words on the driver: for looking at small tables only."""
        return {bytes(r.word): r.c for r in self.words.collect()}

    @property
    def slabs(self) -> int:
        return max(SLABS, -(-self.n_frequent // SLAB_WORDS))

    def n_symbols(self) -> int:
        return self.n_frequent + len(self.counts)

    def share_total(self) -> float:
        return self.tokens + ADD * self.n_symbols()

    def base_total(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.size + 1)))

    def class_logs(self) -> np.ndarray:
        """log10 of the denominator of a rare word's share of its class; 0 for the end."""
        return np.append(0.0, np.log10(self.counts[1:] + ADD * (self.distinct + 1)))


def class_of(classes: int) -> Column:
    return F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(classes)).cast("int")


def vocabulary(counts: DataFrame, frequent: int | None, classes: int, often: int = 1) -> Vocabulary:
    """Frequent: counted at least ``often`` times, or with a bound ``frequent`` the least count that fits it."""
    body = counts.filter(F.col("word") != F.lit(END))
    cut = often
    if frequent is not None:
        step = F.floor(F.log2("c") * 16)
        sizes = body.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
        fits, held = 1 << 62, 0
        for r in sorted(sizes, key=lambda r: -r.step):
            if held + r.n > frequent:
                break
            fits, held = r.c, held + r.n
        cut = max(cut, fits)
    top = body.filter(F.col("c") >= cut).agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
    rare = (
        body.filter(F.col("c") < cut)
        .groupBy(class_of(classes).alias("k"))
        .agg(F.sum("c").alias("c"), F.count("*").alias("n"))
        .collect()
    )
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    symbols, distinct = np.zeros(1 + classes), np.zeros(classes)
    symbols[0] = ends
    for r in rare:
        symbols[1 + r.k], distinct[r.k] = r.c, r.n
    tokens = int(symbols.sum()) + (top.c or 0)
    return Vocabulary(counts, symbols, distinct, top.n, tokens, top.n + int(distinct.sum()) + (ends > 0), cut)


def numbered_words(vocab: Vocabulary) -> DataFrame:
    """(word, c, slab, idx): where each word's emissions are."""
    slab = F.pmod(F.xxhash64("word"), F.lit(vocab.slabs)).cast("int")
    placed = vocab.words.select("word", "c", slab.alias("slab"))
    return placed.withColumn("idx", F.row_number().over(Window.partitionBy("slab").orderBy("word")) - 1)


def lexicon(encoded: DataFrame, vocab: Vocabulary, numbered: DataFrame) -> DataFrame:
    """What the words of a part are.

    Its row of slab -1 has their symbols and training counts by number; a row per slab
    has the places of its frequent words there, which are symbols in this order.
    """
    classes = len(vocab.distinct)
    rare = vocab.table.filter((F.col("c") < vocab.cut) | (F.col("word") == F.lit(END)))
    rare = rare.select("word", "c", F.lit(None).cast("int").alias("slab"), F.lit(None).cast("int").alias("idx"))
    known = listed_words(encoded).join(numbered.unionByName(rare), "word", "left")

    def look_up(t: pa.Table) -> pa.Table:
        pos, k = t.column("pos").to_numpy(), t.column("k").to_numpy()
        slab, idx, c = (t.column(n).fill_null(-1 if n != "c" else 0).to_numpy() for n in ("slab", "idx", "c"))
        code, seen = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
        code[pos], seen[pos] = 1 + k, c
        code[0] = 0
        own = np.flatnonzero(slab >= 0)
        own = own[np.lexsort((idx[own], slab[own]))]
        code[pos[own]] = 1 + classes + np.arange(len(own))
        there, first = np.unique(slab[own], return_index=True)
        places = np.split(idx[own].astype(np.int32), first[1:]) if len(own) else []
        return pa.table(
            [
                pa.array([t.column("part")[0].as_py()] * (1 + len(there)), pa.int64()),
                pa.array([-1, *there.tolist()], pa.int32()),
                pa.array([pack(code), *map(pack, places)], pa.binary()),
                pa.array([seen.tobytes()] + [None] * len(there), pa.binary()),
            ],
            ["part", "slab", "idx", "data"],
        )

    columns = ("part", "pos", "c", "slab", "idx", class_of(classes).alias("k"))
    return known.select(*columns).groupBy("part").applyInArrow(look_up, PIECE)


@dataclass
class Model:
    start: np.ndarray  # per state
    move: np.ndarray  # state to state
    emit: np.ndarray  # symbol by state; of the words only those of the part at hand


@dataclass
class Common:
    """What is not kept per word: the model of end and classes, and how a word's sums become emissions."""

    model: Model
    room: np.ndarray  # per state, dealt by the corpus-wide shares
    floor: float
    norm: np.ndarray
    share_total: float

    def emissions(self, emitted: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (emitted + self.room * ((c + ADD) / self.share_total)[:, None] + self.floor) / self.norm


def first_guess(numbered: DataFrame, vocab: Vocabulary, states: int) -> DataFrame:
    """States that stay, each with its own tilt of the corpus-wide word shares; per slab."""
    total = vocab.share_total()

    def tilt(t: pa.Table) -> pa.Table:
        slab = t.column("slab")[0].as_py()
        c = np.zeros(len(t))
        c[t.column("idx").to_numpy()] = t.column("c").to_numpy()
        emitted = _tilted(c, total, states, slab + 1)
        return _sums(slab, c, emitted, emitted.sum(0))

    return numbered.select("slab", "idx", "c").groupBy("slab").applyInArrow(tilt, SUMS)


def _tilted(c: np.ndarray, total: float, states: int, seed: int) -> np.ndarray:
    return ((c + ADD) / total)[:, None] * np.exp(np.random.default_rng([1, seed]).normal(size=(len(c), states)))


def _sums(slab: int, c: np.ndarray | None, emitted: np.ndarray | None, sums: np.ndarray) -> pa.Table:
    emitted = None if emitted is None else pack(emitted.astype(np.float32))
    blobs = [pa.array([x], pa.binary()) for x in (None if c is None else c.tobytes(), emitted, sums.tobytes())]
    return pa.table([pa.array([slab], pa.int32()), *blobs], ["slab", "c", "emitted", "sums"])


def first_common(vocab: Vocabulary, guess: DataFrame, states: int) -> Common:
    own = _tilted(vocab.counts, vocab.share_total(), states, 0)
    norm = own.sum(0) + sum(np.frombuffer(bytes(r.sums)) for r in guess.select("sums").collect())
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, own / norm)
    return Common(model, np.zeros(states), 0.0, norm, vocab.share_total())


def reestimate(vocab: Vocabulary, expected: DataFrame, states: int) -> Common:
    """The next model from the sums of a round; those of words stay in ``expected``."""
    total, least, parts = np.zeros(states), np.zeros(states), {}
    for r in expected.select("slab", "sums").collect():
        sums = np.frombuffer(bytes(r.sums)).reshape(-1, states)
        if r.slab < 0:
            parts[r.slab] = sums
        else:
            total, least = total + sums[0], least + sums[1]
    n = len(vocab.counts)
    rest = np.concatenate([parts[-1 - k] for k in range(SLABS)]) if parts else np.zeros((n + states + 1, states))
    emitted, moved, started = rest[:n], rest[n : n + states] + 1.0, rest[n + states] + 1.0
    # Each state keeps as much room for what it has not emitted as it has distinct symbols.
    room = least + np.minimum(emitted, 1.0).sum(0)
    norm = total + emitted.sum(0) + room + FLOOR * vocab.n_symbols()
    out = Common(Model(started / started.sum(), moved / moved.sum(1, keepdims=True), emitted), room, FLOOR, norm, vocab.share_total())
    out.model.emit = out.emissions(emitted, vocab.counts)
    return out


class Walk:
    """Texts side by side, the longest first; step t holds the first ``n[t]`` of them."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        size = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        begin = np.cumsum(size) - size
        self.n = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        self.at = np.append(0, np.cumsum(self.n))
        self.symbols = np.empty(len(flat), np.int32)
        for t, n in enumerate(self.n):
            self.symbols[self.at[t] : self.at[t + 1]] = flat[begin[:n] + t]

    def forward(self, model: Model, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values, their scales, and the emissions, step by step."""
        move, ones = model.move.astype(kind), np.ones(len(model.start), kind)
        emitted = model.emit.astype(kind).take(self.symbols, axis=0)
        alpha, scale = np.empty_like(emitted), np.empty(len(emitted), kind)
        at = self.at
        for t, n in enumerate(self.n):
            now = alpha[at[t] : at[t + 1]]
            if t:
                np.matmul(alpha[at[t - 1] : at[t - 1] + n], move, out=now)
            else:
                now[:] = model.start
            now *= emitted[at[t] : at[t + 1]]
            c = scale[at[t] : at[t + 1]]
            np.matmul(now, ones, out=c)
            now /= c[:, None]
        return alpha, scale, emitted

    def log10(self, model: Model) -> np.ndarray:
        _, scale, _ = self.forward(model, np.float64)
        logs = np.log10(scale)
        total = np.zeros(self.n[0])
        for t, n in enumerate(self.n):
            total[:n] += logs[self.at[t] : self.at[t + 1]]
        return total

    def expect(self, model: Model, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """Add this block's expected counts."""
        alpha, scale, out = self.forward(model, np.float32)
        back = np.ascontiguousarray(model.move.T.astype(np.float32))
        out /= scale[:, None]
        at, beta = self.at, np.ones_like(alpha)
        pairs = np.zeros(moved.shape, np.float64)
        for t in range(len(self.n) - 1, 0, -1):
            n = self.n[t]
            later = out[at[t] : at[t + 1]]
            later *= beta[at[t] : at[t + 1]]
            before = slice(at[t - 1], at[t - 1] + n)
            pairs += alpha[before].T @ later
            np.matmul(later, back, out=beta[before])
        alpha *= beta
        moved += pairs * model.move
        started += alpha[: self.n[0]].sum(0)
        for k in range(alpha.shape[1]):
            emitted[:, k] += np.bincount(self.symbols, alpha[:, k], len(emitted))


def blocks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Which texts are walked together: longest first, in blocks of bounded size."""
    some: list[int] = []
    held = 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        some.append(k)
        held += len(texts[k])
        if held >= BLOCK:
            yield some
            some, held = [], 0
    if some:
        yield some


def pieces(sums: DataFrame, words: DataFrame, common: Common) -> DataFrame:
    """Per part what its words are, and the emissions of its frequent words slab by slab."""
    shared = words.sparkSession.sparkContext.broadcast(common)

    def deal(slab: pa.Table, parts: pa.Table) -> pa.Table:
        data = []
        if len(parts):
            c = np.frombuffer(slab.column("c")[0].as_py())
            emitted = unpack(slab.column("emitted")[0].as_py(), np.float32).reshape(len(c), -1)
            emit = shared.value.emissions(emitted, c).astype(np.float32)
            data = [pack(emit[unpack(x, np.int32)]) for x in parts.column("idx").to_pylist()]
        return pa.table([*(parts.column(n) for n in ("part", "slab", "idx")), pa.array(data, pa.binary())], ["part", "slab", "idx", "data"])

    wanted = words.filter("slab >= 0").groupBy("slab")
    dealt = sums.filter("slab >= 0").groupBy("slab").cogroup(wanted).applyInArrow(deal, PIECE)
    return dealt.unionByName(words.filter("slab < 0"))


def _part(texts: pa.Table, told: pa.Table, common: Common) -> tuple[Model, list[np.ndarray], np.ndarray, np.ndarray, list[tuple]]:
    """A part's model, its texts as symbols and as numbers, its words' counts, and whose emissions are where."""
    rows = sorted(zip(*(told.column(n).to_pylist() for n in ("slab", "idx", "data"))), key=lambda r: r[0])
    (_, code, seen), own = rows[0], rows[1:]
    code, seen = unpack(code, np.int32), np.frombuffer(seen, np.int64)
    k = len(common.model.start)
    emit = np.concatenate([common.model.emit, *(unpack(data, np.float32).reshape(-1, k) for _, _, data in own)])
    numbers = [unpack(s, np.int32) for s in texts.column("symbols").to_pylist()]
    return Model(common.model.start, common.model.move, emit), numbers, code, seen, own


def expected_counts(rows: DataFrame, given: DataFrame, guess: DataFrame, common: Common) -> DataFrame:
    """One Baum-Welch pass over ``rows``; per slab the sums over all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        slabs, idx, data = [], [], []
        if len(texts):
            m, numbers, code, _, own = _part(texts, told, shared.value)
            n, k = shared.value.model.emit.shape
            emitted, moved, started = np.zeros(m.emit.shape), np.zeros((k, k)), np.zeros(k)
            for some in blocks(numbers):
                Walk([code[numbers[x]] for x in some]).expect(m, emitted, moved, started)
            for s, part in enumerate(np.array_split(np.vstack([emitted[:n], moved, started]), SLABS)):
                slabs.append(-1 - s)
                idx.append(None)
                data.append(part.tobytes())
            for slab, places, _ in own:
                slabs.append(slab)
                idx.append(places)
                size = len(unpack(places, np.int32))
                data.append(pack(emitted[n : n + size].astype(np.float32)))
                n += size
        part = pa.array([texts.column("part")[0].as_py()] * len(slabs) if slabs else [], pa.int64())
        return pa.table([part, pa.array(slabs, pa.int32()), pa.array(idx, pa.binary()), pa.array(data, pa.binary())], ["part", "slab", "idx", "data"])

    def add(slab: pa.Table) -> pa.Table:
        s = slab.column("slab")[0].as_py()
        data = slab.column("data").to_pylist()
        if s < 0:
            return _sums(s, None, None, sum(map(np.frombuffer, data)))
        c, total = None, None
        for places, x in sorted(zip(slab.column("idx").to_pylist(), data), key=lambda r: r[0] is not None):
            if places is None:
                c = np.frombuffer(x)
                total = np.zeros((len(c), k))
            else:
                total[unpack(places, np.int32)] += unpack(x, np.float32).reshape(-1, k)
        return _sums(s, c, total, np.vstack([total.sum(0), np.minimum(total, 1.0).sum(0)]))

    k = len(common.model.start)
    counted = rows.select("part", "symbols").groupBy("part").cogroup(given.groupBy("part")).applyInArrow(run, PIECE)
    none = F.lit(None)
    all_words = guess.select(none.cast("long").alias("part"), "slab", none.cast("binary").alias("idx"), F.col("c").alias("data"))
    return counted.unionByName(all_words).groupBy("slab").applyInArrow(add, SUMS)


def score(
    df: DataFrame,
    training: Column,
    text: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
    frequent: int | None = None,
    classes: int = CLASSES,
    often: int = OFTEN,
) -> DataFrame:
    """Fit on the rows where ``training`` holds and score all rows.

    Words that training rows hold ``often`` times have emissions of their own, at any size of the
    table; a caller may bound their number with ``frequent``.

    Instead of the text there are ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (add-0.1 unigram, log10) and ``score`` (the model's log10
    probability of the text). Null counts as the empty text, which is its end alone;
    a null ``training`` counts as false. Columns with these names are replaced,
    repeated rows are scored alike, and without training rows all words are unseen.
    """
    stage = Stage(df.sparkSession, "hmm")
    trained = F.coalesce(training, F.lit(False))
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in df.columns if c not in (text, *made)]
    # Other columns travel in a struct, out of the way of those made here.
    aside = F.struct(*kept) if kept else F.lit(None).cast("string")
    source = df.select(aside.alias("_kept"), trained.alias("_trained"), F.encode(F.col(text), "utf-8").alias("_text"))
    # A key that is written with the rows stays theirs whatever is run again.
    encoded = stage.keep_only(encode(with_row_key(source, "_row")), "symbols")
    rows = encoded.filter(F.col("words").isNull())
    vocab = vocabulary(stage.keep_only(training_counts(encoded), "counts"), frequent, classes, often)
    numbered = stage.keep_only(numbered_words(vocab), "numbered")
    words = stage.keep_only(lexicon(encoded, vocab, numbered), "lexicon")
    guess = sums = stage.keep_only(first_guess(numbered, vocab, states), "guess")
    common = first_common(vocab, guess, states)
    latest = None
    for _ in range(rounds):
        given = pieces(sums, words, common)
        before, latest = latest, Stage(df.sparkSession, "hmm-sums")
        sums = latest.keep_only(expected_counts(rows.filter("_trained"), given, guess, common), "sums")
        if before:
            before.drop()
        common = reestimate(vocab, sums, states)

    shared = df.sparkSession.sparkContext.broadcast((common, vocab.class_logs()))
    base_total = vocab.base_total()

    def walk(texts: pa.Table, told: pa.Table) -> pa.Table:
        common, class_logs = shared.value
        m, numbers, code, seen, _ = _part(texts, told, common)
        word_logs = np.log10(seen + ADD)
        # A class's symbol says which, the word's share of the class how much of it.
        rare = (code > 0) & (code < len(class_logs))
        rest = np.where(rare, word_logs - class_logs[np.where(rare, code, 0)], 0.0)
        logs = np.zeros(len(numbers))
        for some in blocks(numbers):
            logs[some] = Walk([code[numbers[k]] for k in some]).log10(m)
        made = [
            pa.array([len(t) for t in numbers], pa.int64()),
            pa.array([int((seen[t] > 0).sum()) for t in numbers], pa.int64()),
            pa.array([word_logs[t].sum() - len(t) * base_total for t in numbers], pa.float64()),
            pa.array([log + rest[t].sum() for log, t in zip(logs, numbers)], pa.float64()),
        ]
        return pa.table([texts.column("_kept"), *made], ["_kept", "n_tokens", "n_known", "base_score", "score"])

    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([rows.schema["_kept"], *(T.StructField(*f) for f in fields)])
    given = pieces(sums, words, common)
    walked = rows.select("part", "_kept", "symbols").groupBy("part").cogroup(given.groupBy("part")).applyInArrow(walk, schema)
    return walked.select(
        *(F.col("_kept").getField(c).alias(c) for c in kept),
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
