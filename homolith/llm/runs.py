"""Periodic runs of words: longest previous factors, their blocks, extensions about block boundaries, copies within blocks."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, table, tidy

#: A run has at least so many words, and so many periods.
LEAST, POWER = 6, 4
#: Words of the documents that are taken together; a longer document is taken alone.
TOGETHER = 1 << 18


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array, and for each k the rank of the 2^k codes from each place on (equal where they are equal).

    Prefix doubling: what is alone in its rank isn't sorted again. Codes must end with one that stands nowhere else."""
    n = len(codes)
    order = np.argsort(codes)
    held = codes[order]
    rank = np.empty(n, np.int32)
    slots, places, levels, step = np.arange(n), order, [], 1
    while True:
        new = np.ones(len(held), bool)
        new[1:] = held[1:] != held[:-1]
        rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))]
        levels.append(rank.copy())
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if not len(slots):
            return order, levels
        places = order[slots]
        held = rank[places].astype(np.int64) * (n + 1) + rank[places + step]
        by = np.argsort(held)
        held, places = held[by], places[by]
        order[slots] = places
        step *= 2


def _ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes from places i and j on are equal (i and j differ)."""
    out, live = np.zeros(len(i), np.int64), [np.arange(len(i))]
    for r in levels:
        at = live[-1]
        at = at[r[i[at]] == r[j[at]]]
        if not len(at):
            break
        live.append(at)
    for k in range(len(live) - 2, -1, -1):
        at = live[k + 1]
        more = levels[k][i[at] + out[at]] == levels[k][j[at] + out[at]]
        out[at[more]] += 1 << k
    return out


def _behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes just before places i < j are equal. The code at 0 must stand nowhere else."""
    out, live = np.zeros(len(i), np.int64), [np.arange(len(i))]
    for k, r in enumerate(levels):
        at = live[-1]
        at = at[i[at] >= 1 << k]
        at = at[r[i[at] - (1 << k)] == r[j[at] - (1 << k)]]
        if not len(at):
            break
        live.append(at)
    for k in range(len(live) - 2, -1, -1):
        at = live[k + 1]
        at = at[i[at] - out[at] >= 1 << k]
        more = levels[k][i[at] - out[at] - (1 << k)] == levels[k][j[at] - out[at] - (1 << k)]
        out[at[more]] += 1 << k
    return out


def _smaller_before(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix array, the nearest place before it of a smaller suffix number (-1: none, or nothing in
    common with it), and the length that both have in common. Pointers jump over pointers; minima go along."""
    p, least = np.arange(-1, len(order) - 1), common.copy()
    live = np.flatnonzero(least > 0)
    while True:
        live = live[order[p[live]] > order[live]]
        if not len(live):
            return p, least
        q = p[live]
        jumped, low = p[q], np.minimum(least[live], least[q])
        p[live], least[live] = jumped, low
        live = live[low > 0]


def previous_factors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each place the length of the longest factor that also starts at an earlier place, such a place, and suffixes()'s ranks."""
    order, levels = suffixes(codes)
    common = np.zeros(len(order), np.int64)
    common[1:] = _ahead(levels, order[:-1], order[1:])
    left, low = _smaller_before(order, common)
    turned, back = _smaller_before(order[::-1], np.append(0, common[:0:-1]))
    right, high = len(order) - 1 - turned[::-1], back[::-1]
    length, source = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    length[order] = np.maximum(low, high)
    source[order] = order[np.where(low >= high, left, np.minimum(right, len(order) - 1))]
    return length, source, levels


def blocks(length: np.ndarray) -> np.ndarray:
    """Where the blocks start: each is the longest previous factor, or one new code. Codes that stand at one place alone are blocks."""
    edge, at = np.ones(len(length), bool), 0
    for i, n in zip((long := np.flatnonzero(length > 1)).tolist(), length[long].tolist(), strict=True):
        if i >= at:
            at = i + n
            edge[i + 1 : at] = False
    return np.flatnonzero(edge)


def _repeat(start: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each start as often as it has times, with 1, 2, ... beside it."""
    n = np.cumsum(times)
    return np.repeat(start, times), np.arange(1, (n[-1] if len(n) else 0) + 1) - np.repeat(n - times, times)


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document's words, by start and period. `words` numbers the words of all documents
    in a row (equal words, equal numbers), `sizes` has the number of words of each.

    A run with `power` periods that touches a block boundary b has two periods on one side of it. On the right: the run's last
    boundary begins a block that reaches its end (what follows has occurred a period before), so the period is at most half
    of that block. On the left: the run's part in front of b begins less than a period behind the block before b, or the run
    would be in one block, so the period is at most that block's length. Each of these periods is tried at b, by extension to
    both sides. All other runs lie within a block, and are copied from its source, by start, those within the copy itself too.
    """
    if power < 4:
        raise ValueError("runs of fewer than four periods aren't looked for")
    # Between documents, in front and at the end stands a code of its own; one word has different codes in two documents.
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(words)) + owner + 1
    codes = np.arange(len(words) + len(sizes) + 1) - (len(words) + len(sizes) + 1)
    codes[inside] = owner * (int(words.max(initial=0)) + 1) + words
    low = np.cumsum(sizes + 1) - sizes
    length, source, levels = previous_factors(codes)
    b = blocks(length)
    size, before = np.diff(b, append=len(codes)), np.diff(b, prepend=0)
    at, q = _repeat(b, size // 2)
    keep = codes[at] == codes[at + q]
    i, period = [at[keep]], [q[keep]]
    at, q = _repeat(b, np.minimum(before, b // 2))
    keep = codes[at - 1] == codes[at - 1 - q]
    i.append(at[keep] - q[keep])
    period.append(q[keep])
    i, period = np.concatenate(i), np.concatenate(period)
    back, ahead = _behind(levels, i, i + period), _ahead(levels, i, i + period)
    keep = back + period + ahead >= np.maximum(least, power * period)
    start, end, period = (i - back)[keep], (i + period + ahead)[keep], period[keep]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # Of the periods of one stretch the smallest, of which the others are multiples.
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    found = list(zip(start[first].tolist(), end[first].tolist(), period[first].tolist(), strict=True))
    if found:
        wide = np.flatnonzero(size >= least + 2)
        _copied(found, b[wide].tolist(), (b + size)[wide].tolist(), source[b[wide]].tolist(), least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for s, e, p in found:
        d = int(np.searchsorted(low, s, "right")) - 1
        out[d].append((s - int(low[d]), e - s, p))
    return out


def _copied(own: list[tuple[int, int, int]], begin: list[int], end: list[int], source: list[int], least: int) -> None:
    """Adds to the runs (start, end, period) those within blocks, from the runs within the blocks' sources."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in own:
        buckets.setdefault(s, []).append((e, p))
    starts = sorted(buckets)
    for at, to, of in zip(begin, end, source, strict=True):
        shift = at - of
        k = bisect_right(starts, of)
        while k < len(starts) and starts[k] < to - shift - least:
            s = starts[k]
            inside = [(e + shift, p) for e, p in buckets[s] if e < to - shift]
            if inside:
                if s + shift not in buckets:
                    insort(starts, s + shift)
                buckets.setdefault(s + shift, []).extend(inside)
                own.extend((s + shift, e, p) for e, p in inside)
            k += 1
    own.sort(key=lambda r: (r[0], r[2]))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has. A null text has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return words.filter(pa.array(there)), np.diff(np.append(0, np.cumsum(there))[ends])


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words without those that a run has after its first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return " ".join([words[i] for i in np.flatnonzero(keep)])


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """Per document: doc_id, n_words, runs array<struct<start, length, period>> (by start, then period), collapsed (its words without
    the repetitions, joined by one space).

    Words are what stands between white space of ASCII. A null or blank text has no words, no runs and an empty collapsed text;
    repeated rows each get theirs; a null id is kept; other columns are not read. A task holds some forty numbers for each word
    of the documents that it takes together (TOGETHER words, or one longer document).
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def made(b: pa.RecordBatch, words: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        found = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), sizes, least, power)
        flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        spans = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run_type)))
        at = np.append(0, np.cumsum(sizes))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ")
        if len(flat):
            texts = pa.array([collapsed(words[i:j].to_pylist(), f) if f else t.as_py() for i, j, f, t in zip(at[:-1].tolist(), at[1:].tolist(), found, texts, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), spans, texts], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            words, sizes = split(b.column(1))
            total, at = np.append(0, np.cumsum(sizes)), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(total, total[at] + TOGETHER, "right")) - 1)
                yield made(b.slice(at, to - at), words[int(total[at]) : int(total[to])], sizes[at:to])
                at = to

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts repeat themselves for one id in ten: with h the CRC of the decimal id (null: of nothing) and h % 10 = 0,
    the n words from a = floor(h / 10) % n on are the p words from a on again and again, p = 1 + floor((n - a) / (3 + floor(h / 10) % 8))."""
    h, g, w = fresh(docs, "__h", "__g", "__w")
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n = F.size(w).cast("long")
    a = F.col(g) % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col(g) % 8)).cast("long")
    again = F.transform(F.col(w), lambda x, i: F.when(i < a, x).otherwise(F.get(F.col(w), (a + (i - a) % p).cast("int"))))
    out = docs.withColumn(h, F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")))
    out = out.withColumn(g, F.floor(F.col(h) / 10).cast("long")).withColumn(w, F.when(F.col(h) % 10 == 0, words))
    return out.withColumn(text, F.when(F.size(w) > 0, F.array_join(again, " ")).otherwise(F.col(text))).drop(h, g, w)


def query(spark, sf_dir: str) -> DataFrame:
    found = runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    r = F.col("runs")
    # Lengths and periods are below 2^31, so products of two are exact.
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] <= y["period"]))))
    best = F.when(F.size(r) > 0, F.aggregate(r, F.get(r, F.lit(0)), lambda x, y: F.when(better(x, y), x).otherwise(y)))
    listed = F.array_join(F.transform(r, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exact = F.expr("best.length * 1000L div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
