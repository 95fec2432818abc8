"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, tidy, written

#: Words of a shingle; bins of a fingerprint (a power of two); bits that are kept of each bin's minimum (4: two bins a byte).
WORDS, BINS, BITS = 5, 512, 4
#: Bytes of text that are hashed together; a longer text is hashed alone.
TOGETHER = 4 << 20
#: Odd multipliers of the hashes of words and of shingles, and the constants of splitmix64.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Up to so many bins with shingles, an empty one looks for the nearest of them in its row of ranks instead of trying bins in turn.
FEW = 16


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A number for each byte, the same for both cases of an ASCII letter; 0 for white space."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    out[65:91] = out[97:123]
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


@lru_cache(1)
def probes() -> tuple[np.ndarray, np.ndarray]:
    """For each bin all bins in the order in which it borrows from them (itself last), and the rank of each bin in that order."""
    draw = mixed(np.arange(BINS * BINS, dtype=np.uint64) * np.uint64(STEP)).reshape(BINS, BINS) >> np.uint64(1)
    np.fill_diagonal(draw, np.uint64(1) << np.uint64(63))
    order = np.argsort(draw, axis=1, kind="stable")
    return order, np.argsort(order, axis=1, kind="stable")


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(max(n + 1, TOGETHER + (1 << 20)), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash of each shingle: WORDS words in a row, or all of a text's words if they are fewer."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    v = byte_values()[raw]
    gap = v == 0
    begin = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    end = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    up, down = powers(len(raw))
    # The value of a word's byte i goes in times BASE^i: prefix sums, moved to the word's start.
    total = np.append(np.uint64(0), np.cumsum(v * up[: len(raw)]))
    word = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    edge = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(begin, edge)
    n = np.diff(last, prepend=0)
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(word)) - np.repeat(last - n, n)
    left = np.repeat(n, n) - place
    sums, factor = np.zeros(len(word), np.uint64), 1
    for t in range(min(WORDS, len(word))):
        part = word[t:] * np.uint64(factor)
        sums[: len(word) - t] += np.where(left[: len(word) - t] > t, part, np.uint64(0))
        factor = factor * STEP % (1 << 64)
    keep = (left >= WORDS) | (place == 0)
    return owner[keep], mixed(sums[keep])


def minima(texts: list[bytes]) -> np.ndarray:
    """For each text the bits that are kept of each bin's minimum, uint8; a row of 255 for a text without words."""
    owner, h = shingle_hashes(texts)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(texts) * BINS, none)
    # The top bits choose the bin, what is below them is its value.
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    np.minimum.at(least, owner * BINS + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    filled = (least != none).reshape(-1, BINS)
    out = np.where(filled, (least & np.uint64((1 << BITS) - 1)).reshape(-1, BINS), 255).astype(np.uint8)
    order, rank = probes()
    count = filled.sum(axis=1)
    for i in np.flatnonzero((count > 0) & (count <= FEW)):
        held, empty = np.flatnonzero(filled[i]), np.flatnonzero(~filled[i])
        out[i, empty] = out[i, held[rank[np.ix_(empty, held)].argmin(axis=1)]]
    row, bin_ = np.nonzero(~filled & (count > FEW)[:, None])
    turn = 0
    while len(row):
        other = order[bin_, turn]
        hit = filled[row, other]
        out[row[hit], bin_[hit]] = out[row[hit], other[hit]]
        row, bin_ = row[~hit], bin_[~hit]
        turn += 1
    return out


def packed(values: np.ndarray) -> list[bytes]:
    """Fingerprints: two bins a byte; nothing for a text without words."""
    both = (values[:, 0::2] << 4 | values[:, 1::2] & 15).astype(np.uint8)
    return [b"" if v[0] == 255 else p.tobytes() for v, p in zip(values, both, strict=True)]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of minima(): the share of equal bins, less what equal low-order bits of different minima are expected to
    add, from 0 to 1. Two texts without words are alike (1), one without and one with words aren't (0)."""
    chance = 0.5**BITS
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def unpacked(prints) -> np.ndarray:
    """minima() of fingerprints."""
    out = np.full((len(prints), BINS), 255, np.uint8)
    for i, p in enumerate(prints):
        if p:
            x = np.frombuffer(p, np.uint8)
            out[i, 0::2], out[i, 1::2] = x >> 4, x & 15
    return out


def likeness(a, b) -> F.Column:
    """Likeness of two columns of fingerprints (null counts as a text without words)."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alike(unpacked(x.to_list()), unpacked(y.to_list())))

    return of(a, b)


def _minima(texts: list[str]) -> np.ndarray:
    """minima() of any number of texts, some MB at a time."""
    out, held, size = [np.zeros((0, BINS), np.uint8)], [], 0
    for t in texts:
        raw = t.encode()
        if held and size + len(raw) > TOGETHER:
            out.append(minima(held))
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        out.append(minima(held))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint binary (BINS * BITS / 8 bytes, equal for equal texts).

    Shingles are five words between ASCII white space, A-Z as a-z; fewer words are one shingle. A null, empty or blank text has
    an empty fingerprint; repeated rows each get theirs; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(_minima([t.as_py() or "" for t in b.column(1)])), pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fingerprint binary")


FIELDS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _compared(texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    """FIELDS of each text, given the next one and the minima of both."""
    edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following, strict=True)]
    changed = _minima(edited)
    columns = [[len(t) for t in texts], [hashlib.sha256(e.encode()).digest() for e in edited], packed(own), packed(changed), alike(own, changed), alike(own, after)]
    return [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: how like its fingerprint is
    to that of its edited text, and to the next document's. The edited text has the last third of its characters replaced by
    as many of the next document's first (all, if it has fewer); the next one is that of the next smaller id, after the last the first.

    A null text counts as empty; null ids come last; rows of one id follow each other by a hash of their texts, then the texts. A lone
    row is its own next. Rows are sorted over all partitions and read in that order, one at a time; what a partition's
    last row lacks is the first row of the next partition that has any, and these few are joined after the rest is written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    names = ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")], "part", "head", "tail"]

    def run(batches):
        part, held, before = TaskContext.get().partitionId(), None, None

        def edge(id_type, key_, head, tail):
            return pa.RecordBatch.from_arrays([pa.array([key_], id_type), *[pa.array([None], t) for t in _TYPES], pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array([tail], pa.string())], names)

        id_type = None
        for b in batches:
            if not b.num_rows:
                continue
            id_type, ids, texts = b.schema.field(0).type, b.column(0).to_pylist(), b.column(1).to_pylist()
            m = _minima(texts)
            if held is None:
                yield edge(id_type, None, texts[0], None)
            else:
                ids, texts, m = [held[0], *ids], [held[1], *texts], np.concatenate([before, m])
            held, before = (ids[-1], texts[-1]), m[-1:]
            n = len(texts) - 1
            nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], id_type), *_compared(texts[:-1], texts[1:], m[:-1], m[1:]), *nothing], names)
        if held is not None:
            yield edge(id_type, *[held[0], None, held[1]])

    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    found, _ = written(spark, ordered.mapInArrow(tidy(run), f"doc_id {kind}, {FIELDS}, part int, head string, tail string"), "fingerprints")
    heads = found.filter("head IS NOT NULL").select("part", "head")
    follows = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    last = found.filter("tail IS NOT NULL").select("doc_id", "tail", "part").join(follows, "part").drop("part")
    last = last.join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "tail", "head")

    def finish(batches):
        for b in batches:
            texts, following = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), *_compared(texts, following, _minima(texts), _minima(following))], names[:-3])

    done = found.filter("part IS NULL").drop("part", "head", "tail")
    return done.unionByName(last.mapInArrow(tidy(finish), f"doc_id {kind}, {FIELDS}"))


def query(spark, sf_dir: str) -> DataFrame:
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return edited(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
