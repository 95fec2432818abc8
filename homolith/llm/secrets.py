"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

# The patterns of the contract (letters of the first in either case, ASCII only).
ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
HEX_LONG = re.compile("[0-9a-f]{24,}")
#: What the models judge: runs of these characters, of as many as the shortest random string that they are trained on.
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{16,}")
#: Log-likelihood ratio per character above which a candidate is taken for random.
THRESHOLD = 0.7
#: Training samples: so many documents with the smallest hashes at most, of any length, and so many random strings.
TRAIN_DOCS, TRAIN_RANDOM, SEED = 2000, 4000, 3
KINDS = ("assign", "access", "hex", "model")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end): leftmost matches of each kind, those that fail their length dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hexadecimal digits matches whole, so runs of 24 and more are what is left of all runs.
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return out


class Markov:
    """Order-2 character model over a fixed alphabet. Counts after two characters are filled up with `weight` counts that are
    dealt as single characters are; those have 1 more each, so nothing is impossible."""

    ALPHABET = string.ascii_letters + string.digits + "+/_=-"

    def __init__(self, samples, weight: float = 4.0):
        pairs, contexts, single = Counter(), Counter(), Counter(self.ALPHABET)
        for s in samples:
            single.update(s)
            s = "^^" + s
            for i in range(2, len(s)):
                pairs[s[i - 2 : i + 1]] += 1
                contexts[s[i - 2 : i]] += 1
        total = sum(single.values())
        share = {c: n / total for c, n in single.items()}
        self.alone = {c: math.log(p) for c, p in share.items()}
        self.seen = {t: math.log((n + weight * share[t[2]]) / (contexts[t[:2]] + weight)) for t, n in pairs.items()}
        self.left = {t: math.log(weight / (n + weight)) for t, n in contexts.items()}

    def loglik(self, s: str) -> float:
        s = "^^" + s
        total = 0.0
        for i in range(2, len(s)):
            p = self.seen.get(s[i - 2 : i + 1])
            total += p if p is not None else self.left.get(s[i - 2 : i], 0.0) + self.alone[s[i]]
        return total


def random_strings(n: int = TRAIN_RANDOM, seed: int = SEED) -> list[str]:
    """Labelled samples of the one class: strings drawn evenly from the alphabets that keys use."""
    draw = random.Random(seed)
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-")
    return ["".join(draw.choices(sets[i % len(sets)], k=draw.randint(16, 48))) for i in range(n)]


IDENTIFIER = re.compile("[A-Za-z][A-Za-z0-9_-]{2,40}")


def numbers(n: int = TRAIN_RANDOM, seed: int = SEED) -> list[str]:
    """Labelled samples of the other class beside identifiers: long numbers (cards, accounts), even draws but no keys."""
    draw = random.Random(seed)
    return ["".join(draw.choices(string.digits, k=draw.randint(4, 24))) for _ in range(n)]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans (start, kind, end), sorted, cover."""
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def identifiers(text: str) -> set[str]:
    """Words and identifiers outside of the spans that the patterns find."""
    parts, at = [], 0
    for a, b in merged(sorted(base_spans(text))):
        parts.append(text[at:a])
        at = b
    return set(IDENTIFIER.findall(" ".join([*parts, text[at:]])))


def ordinary(words) -> list[str]:
    """Labelled samples of the other class: words, and words joined as identifiers join them."""
    ranked = sorted(set(words), key=lambda w: hashlib.md5(w.encode()).digest())
    draw, out = random.Random(SEED), list(ranked)
    for i in range(0, len(ranked) - 3, 3):
        a, b, c = ranked[i : i + 3]
        out.append(("_".join, "-".join, "/".join, "".join)[draw.randint(0, 3)]([a.lower(), b.lower(), c.lower()]))
        out.append(a.lower() + b.capitalize() + c.capitalize())
    return out


def train(docs: DataFrame, text: str = "text", sample: int = TRAIN_DOCS) -> tuple[Markov, Markov]:
    """Both models. The sample is bounded: the texts of the `sample` smallest hashes, each once and whole. Hashes alone are moved
    to find it; the driver gets the distinct words of these texts."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).select("t", F.xxhash64("t").alias("h"))
    few = F.broadcast(texts.select("h").distinct().orderBy("h").limit(sample))

    def run(batches):
        for b in batches:
            words = set().union(*(identifiers(t.as_py()) for t in b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["w"])

    words = texts.join(few, "h").select("t").mapInArrow(run, "w string").distinct().toArrow()["w"].to_pylist()
    return Markov(random_strings()), Markov((ordinary(words) or ["the"]) + numbers())


def model_spans(text: str, taken: list[tuple[int, int, int]], models: tuple[Markov, Markov], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Candidates of any length, and of those that touch base spans (`taken`, sorted) the pieces outside of them that are long
    enough to be candidates, if they look random by their likelihood ratio per character."""
    out, covered, k = [], merged(taken), 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        pieces, i = [], k
        while i < len(covered) and covered[i][0] < end:
            pieces.append((at, covered[i][0]))
            at = covered[i][1]
            i += 1
        for a, b in [*pieces, (at, end)]:
            s = text[a:b]
            if (not pieces or CANDIDATE.fullmatch(s)) and (models[0].loglik(s) - models[1].loglik(s)) / len(s) > threshold:
                out.append((a, 3, b))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, models: tuple[Markov, Markov], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    What is left of a run beside a base span is judged too, if it is long enough to be one. A null or empty text has no spans (the hash is that of the empty string); repeated rows each get theirs; no other
    column is read. Each text is judged whole, one at a time, in time linear in its length. Spans of one start stand in the
    order of their kinds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = spark.sparkContext.broadcast(models)
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches):
        both = kept.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = sorted(base_spans(t))
                every = sorted(base + model_spans(t, base, both, threshold))
                n = Counter(k for _, k, _ in every)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n[3]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
