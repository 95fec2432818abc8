"""Toxicity: class-conditional Kneser-Ney models of expressions that back off to continuation counts of both classes."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, small_batches, table, tidy, written

#: Parts of the training rows; each part is judged by a model without it when the score is calibrated.
FOLDS = 4
#: Rows of each class that the score is calibrated on at most, those of the smallest hashes. The models count all training rows.
CALIBRATION_ROWS = 4000
#: Ratios above these count as evidence.
EXCESS = (2.0, 3.0)
#: mean ratio, log excess over the first, the same by length, largest ratio, log excess over the second, log length.
FEATURES = 6
#: From this score on a document is rejected.
THRESHOLD = 0.7
#: Cells of a level in which an expression's contexts are counted, and levels: each but the last holds 7 in 8 of the contexts that
#: the ones before it leave. A level with more than FULL filled cells gives way to the next (whose counts stand for 8 times as many),
#: so counts are nearly exact for the rare expressions that need smoothing, within some 20 % beyond, and go on to a million.
CELLS, LEVELS, FULL = 64, 5, 60
#: Expressions that are broadcast at most (16 bytes each); a larger table is joined.
BROADCAST = 4_000_000
#: Training rows (id, hash, label) that are broadcast at most; beyond them texts are moved to their labels.
BROADCAST_ROWS = 1_000_000
#: Expressions whose ratio, or whose counts, a worker keeps; a full cache starts anew, full counts are passed on.
CACHED = 200_000
#: Runs of more letters than this are read as overlapping pieces of PIECE letters.
LONGEST_WORD, PIECE = 24, 8

WORDS = re.compile(r"[^\W\d_]+")
#: Scripts that don't part words: Thai, Lao, Myanmar, Khmer, kana, Han. Their runs are read as overlapping pairs.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
PAIRED = re.compile(f"[{UNSPACED}]")


def held_out(key):
    """Rows that no label is learned from: crc32(doc_id as text) mod 3 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def expressions(text: str) -> list[str]:
    """Runs of letters, in lower case; runs that aren't single words as all their overlapping pieces."""
    low = text.lower()
    words = WORDS.findall(low)
    if max(map(len, words), default=0) <= LONGEST_WORD and (low.isascii() or not PAIRED.search(low)):
        return words
    out = []
    for w in words:
        n = 2 if PAIRED.search(w) else PIECE if len(w) > LONGEST_WORD else len(w)
        out += [w[i : i + n] for i in range(max(len(w) - n, 0) + 1)]
    return out


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Of 1, 2 and 3 or more, from the numbers of expressions that occur once to four times (a number of 0 counts as 1)."""
    n = [max(c, 1) for c in counts]
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.02) for k in (1, 2, 3))


class Smoothing:
    """The numbers of one model: for each class its total of counts, its discounts, and the share that they leave to the
    shared counts, whose total is `contexts`."""

    def __init__(self, totals: tuple[float, float], of_counts: list[list[int]], kinds: list[int], contexts: float):
        self.totals, self.contexts = [max(t, 1) for t in totals], max(contexts, 1.0)
        self.discounts = [discounts(c) for c in of_counts]
        self.free = []
        for c in (0, 1):
            d, n = self.discounts[c], of_counts[c]
            left = d[0] * n[0] + d[1] * n[1] + d[2] * (kinds[c] - n[0] - n[1])
            self.free.append(max(left / self.totals[c], 1e-6) if kinds[c] else 1.0)
        #: Ratio of an expression without counts.
        self.new = math.log(self.free[1] / self.free[0])

    def p(self, count, contexts, c: int):
        """Probability column of an expression in class c: its discounted share of the class's counts, and the free share
        dealt by the number of expressions that it follows in either class."""
        d = self.discounts[c]
        off = F.when(count == 0, 0.0).when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])
        return (count - off) / F.lit(float(self.totals[c])) + F.lit(self.free[c] / self.contexts) * contexts

    def ratio(self, without: int | None = None):
        """Toxic against ordinary log-likelihood of an expression in the table of counts, a fold left out."""
        k, n = contexts(without), [in_class(c, without) for c in (0, 1)]
        return F.when(n[0] + n[1] == 0, self.new).otherwise(F.log(self.p(n[1], k, 1) / self.p(n[0], k, 0)))


class Model:
    """Log ratios of the two models for each expression, as arrays sorted by hash or, beyond BROADCAST, as a table; and the
    weights of the features. Weights of None give every text a score of 0.5."""

    def __init__(self, new: float = 0.0, hashes=None, ratios=None, path: str | None = None, weights=None):
        self.new, self.path, self.weights = new, path, weights
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.ratios = np.zeros(0) if ratios is None else ratios
        self.cache: dict[str, float] = {}

    def look_up(self, words: list[str]) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
        if not len(self.hashes):
            return np.full(len(h), self.new)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ratios[at], self.new)

    def features(self, text: str) -> tuple[float, ...]:
        words, cache = expressions(text), self.cache
        if not words:
            return (0.0,) * FEATURES
        kinds = set(words)
        try:
            once = list(map(cache.__getitem__, kinds))
        except KeyError:
            if len(cache) > CACHED:
                cache.clear()
            missing = [w for w in kinds if w not in cache]
            cache.update(zip(missing, self.look_up(missing).tolist(), strict=True))
            once = [cache[w] for w in kinds]
        n = len(words)
        above = [v for v in once if v > EXCESS[0]]
        low, high = sum(above) - EXCESS[0] * len(above), sum(v - EXCESS[1] for v in above if v > EXCESS[1])
        return (sum(map(cache.__getitem__, words)) / n, math.log1p(low), math.log1p(100 * low / n), max(once), math.log1p(high), math.log(n))

    def judged(self, f: tuple[float, ...]) -> float:
        if self.weights is None:
            return 0.5
        z = float(np.dot(self.weights, (1.0, *f)))
        return 1.0 / (1.0 + math.exp(-max(min(z, 50.0), -50.0)))

    def score(self, text: str) -> float:
        return self.judged(self.features(text))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression of y on the columns of x (put on one scale), the constant first. The constant is set so
    that the cut that separates the rows best has the score THRESHOLD: by F-half, which counts ordinary texts taken for toxic
    more than toxic ones missed."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - middle) / spread], axis=1)
    w, keep = np.zeros(z.shape[1]), np.array([0.0] + [ridge] * x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(np.maximum(keep, 1e-6)), z.T @ (y - q) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    value = z @ w
    order = np.argsort(-value, kind="stable")
    hits = np.cumsum(y[order])
    f_half = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    last = np.append(np.diff(value[order]) != 0, True)  # a cut can't part equal values
    best = int(np.where(last, f_half, -1.0).argmax())
    below = value[order][best + 1] if best + 1 < len(y) else value[order][best] - 1.0
    cut = (value[order][best] + below) / 2
    w = np.concatenate([[w[0] - (w[1:] * middle / spread).sum()], w[1:] / spread])
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return w


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(h, text, toxic, fold): all labelled rows that aren't held out, of equal texts one id's (a text that is toxic once is).
    Labels that are null or contradict each other are left out. Only ids, hashes and labels move before the texts are joined."""
    lab = labels.select(F.col("doc_id").alias("k"), "toxic").filter(F.col("k").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("k")))
    lab = lab.groupBy("k").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("m")).filter("toxic = m").select("k", "toxic")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    one = rows.select("k", "h").join(lab, "k").groupBy("h").agg(F.min("k").alias("k"), F.max("toxic").cast("int").alias("toxic"))
    one, _ = written(docs.sparkSession, one, "toxicity-rows")
    # Up to 20 MB of them; then no text moves.
    return rows.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, ["h", "k"]).select("h", "text", "toxic", F.pmod(F.hash("h"), F.lit(FOLDS)).alias("fold"))


def counted(rows: DataFrame) -> DataFrame:
    """(g, cells0_0 ..., n0 ...): for each expression the texts of each class and fold that have it (n at class * FOLDS + fold),
    and for each fold and level the cells of the expressions before it, as bits. A task passes on one row for each expression, or more
    if it has very many."""
    names, bits = [f"n{i}" for i in range(2 * FOLDS)], [f"cells{i}_{j}" for i in range(FOLDS) for j in range(LEVELS)]

    class Bits(dict):
        def __missing__(self, w):
            self[w] = out = 1 << cell_of(w)
            return out

    def run(batches):
        new = lambda: (Bits(), [defaultdict(int) for _ in range(FOLDS)], [Counter() for _ in names])
        bit, cells, n = new()

        def out():
            g = list(set().union(*n))
            columns = []
            for c in cells:
                raw = b"".join([c.get(w, 0).to_bytes(8 * LEVELS, "little") for w in g])
                columns += [pa.array(np.ascontiguousarray(x)) for x in np.frombuffer(raw, "<i8").reshape(-1, LEVELS).T]
            return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), *columns, *[pa.array([c[w] for w in g], pa.int64()) for c in n]], ["g", *bits, *names])

        for b in batches:
            for t, y, f in zip(*[b.column(i) for i in range(3)], strict=True):
                words = expressions(t.as_py())
                n[y.as_py() * FOLDS + f.as_py()].update(set(words))
                before, own = "", cells[f.as_py()]
                for w in words:
                    own[w] |= bit[before]
                    before = w
                if sum(map(len, cells)) > CACHED:
                    yield out()
                    bit, cells, n = new()
        yield out()

    found = rows.select("text", "toxic", "fold").mapInArrow(tidy(run), "g string, " + ", ".join(f"{c} long" for c in [*bits, *names]))
    return found.groupBy("g").agg(*[F.bit_or(c).alias(c) for c in bits], *[F.sum(c).alias(c) for c in names])


def cell_of(context: str) -> int:
    """The cell, counted over all levels, that a context fills."""
    h = xxhash.xxh64_intdigest(context, 7)
    level, rest = 0, h >> 6
    while level < LEVELS - 1 and not rest & 7:
        level, rest = level + 1, rest >> 3
    return level * CELLS + h % CELLS


def contexts(without: int | None = None):
    """Number of contexts, without those of a fold, from the cells that they fill (linear counting of the first level that isn't full,
    and of those behind it)."""
    filled = [F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"cells{f}_{j}") for f in range(FOLDS) if f != without])).cast("double") for j in range(LEVELS)]
    count = [-CELLS * F.log(1 - F.least(x, F.lit(CELLS - 0.5)) / CELLS) for x in filled]
    found = [F.lit(8.0**j) * reduce(lambda a, b: a + b, count[j:]) for j in range(LEVELS)]
    return F.coalesce(*[F.when(x <= FULL, n) for x, n in zip(filled[:-1], found, strict=False)], found[-1])


def in_class(c: int, without: int | None = None):
    """Count column of a class, without a fold."""
    return reduce(lambda a, b: a + b, [F.col(f"n{c * FOLDS + f}") for f in range(FOLDS) if f != without])


def smoothings(words: DataFrame) -> list[Smoothing]:
    """Of the model without each fold, and last of the whole one: sums over the table of counts, one row."""
    sums, models = [], [*range(FOLDS), None]
    for f in models:
        sums.append(F.sum(contexts(f)))
        for c in (0, 1):
            n = in_class(c, f)
            sums += [F.sum(n), F.count_if(n > 0), *[F.count_if(n == k) for k in (1, 2, 3, 4)]]
    row = [v or 0 for v in words.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    out = []
    for i in range(len(models)):
        k, a, b = row[13 * i], row[13 * i + 1 : 13 * i + 7], row[13 * i + 7 : 13 * i + 13]
        out.append(Smoothing((a[0], b[0]), [a[2:], b[2:]], [a[1], b[1]], k))
    return out


def exploded(rows: DataFrame) -> DataFrame:
    """(h, g, n, length) for rows of h and text: how often a text has each of its expressions, of how many."""

    def run(batches):
        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = Counter(expressions(t.as_py() or ""))
                if words:
                    k, size = len(words), sum(words.values())
                    yield pa.RecordBatch.from_arrays([pa.array([h] * k, pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.array([size] * k, pa.int64())], ["h", "g", "n", "length"])

    return rows.select("h", "text").mapInArrow(tidy(run), "h long, g string, n long, length long")


def joined_features(found: DataFrame) -> DataFrame:
    """(h, f0 ...): Model.features() of the texts of exploded() rows that have their ratio r. Rows of a text that stands
    several times are several times there, which the sums are divided by."""
    times = F.sum("n") / F.first("length")
    low, high = (F.sum(F.greatest(F.col("r") - e, F.lit(0.0))) / times for e in EXCESS)
    n = F.first("length")
    f = [F.sum(F.col("n") * F.col("r")) / F.sum("n"), F.log1p(low), F.log1p(100 * low / n), F.max("r"), F.log1p(high), F.log(n)]
    return found.groupBy("h").agg(*[x.alias(f"f{i}") for i, x in enumerate(f)])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = CALIBRATION_ROWS, most: int = BROADCAST) -> Model:
    """A model counted over all training rows, whose score is calibrated on rows that models without their fold have judged.

    Counts, discounts and ratios are made on the executors; the driver gets sums, the features of 2 * `rows` texts at most,
    and the ratios of `most` expressions at most: a larger table stays where it is, and texts are joined with it. Without
    labels of both classes every score is 0.5 (nothing is predicted toxic).
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = training_rows(docs, labels, key, text)
    words, words_path = written(spark, counted(sample), "toxicity-counts")
    every = smoothings(words)
    ratio = [s.ratio(f) for s, f in zip(every, [*range(FOLDS), None], strict=True)]
    weights = None
    few = sample.select("h", "toxic", "fold")
    few = [few.filter(F.col("toxic") == c).orderBy("h").limit(rows) for c in (0, 1)]
    # 2 * rows hashes at most.
    few = F.broadcast(few[0].unionAll(few[1]).dropDuplicates(["h"]))
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).join(few.select("h"), "h").dropDuplicates(["h"])
    found = exploded(texts).join(few.select("h", "fold"), "h").join(words, "g")
    own = F.coalesce(*[F.when(F.col("fold") == f, ratio[f]) for f in range(FOLDS)])
    names = [f"f{i}" for i in range(FEATURES)]
    held = few.join(joined_features(found.withColumn("r", own)), "h", "left").select("toxic", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]).toPandas().sort_values(["toxic", *names])
    if held["toxic"].nunique() == 2:
        weights = fitted(held[names].to_numpy(float), held["toxic"].to_numpy(float))
    made = words.select("g", ratio[-1].alias("r"))
    if words.count() <= most:
        t = made.select(F.xxhash64("g").alias("h"), "r").toArrow()
        h, r = t["h"].to_numpy().view(np.uint64), t["r"].to_numpy()
        order = np.argsort(h, kind="stable")
        drop(spark, words_path)
        return Model(every[-1].new, h[order], r[order], weights=weights)
    _, path = written(spark, made, "toxicity-ratios")
    drop(spark, words_path)
    return Model(every[-1].new, path=path, weights=weights)


def joined_scores(texts: DataFrame, model: Model) -> DataFrame:
    """(h, score, best_ratio, text_ratio) of texts (h, text) by joining their expressions with the table of ratios."""
    spark = texts.sparkSession
    ratios = spark.read.schema("g string, r double").parquet(model.path)
    found = exploded(texts).join(ratios, "g", "left").withColumn("r", F.coalesce("r", F.lit(model.new)))
    f = joined_features(found)
    z = F.lit(float(model.weights[0])) + sum((F.col(f"f{i}") * float(model.weights[i + 1]) for i in range(FEATURES)), F.lit(0.0)) if model.weights is not None else F.lit(0.0)
    return f.select("h", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))).alias("score"), F.col("f3").alias("best_ratio"), F.col("f0").alias("text_ratio"))


def hashed(docs: DataFrame, text: str):
    return docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, best_ratio, text_ratio.

    A null or empty text has ratios of 0 and the score of that; repeated rows are scored each; only the text is an input,
    and all of it is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    if model.path:
        rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
        none = model.judged((0.0,) * FEATURES)
        found = rows.join(joined_scores(hashed(docs, text), model), "h", "left").select("doc_id", F.coalesce("score", F.lit(none)).alias("score"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("best_ratio", "text_ratio")])
    else:
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            m = shared.value
            for b in batches:
                f = [m.features(t.as_py() or "") for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, pa.float64()) for v in ([m.judged(x) for x in f], [x[3] for x in f], [x[0] for x in f])]], ["doc_id", "score", "best_ratio", "text_ratio"])

        found = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double, best_ratio double, text_ratio double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "best_ratio", "text_ratio")


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with docs' columns, that the model doesn't reject. Empty and null texts are judged as texts without
    evidence; an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    if model.path:
        bad = joined_scores(hashed(docs, text), model).filter(F.col("score") >= threshold).select("h")
        own = F.xxhash64(F.coalesce(docs[text], F.lit("")))
        return docs.join(bad, own == bad["h"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t.as_py() or "") < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
