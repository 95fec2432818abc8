"""Fill-in-middle transformation: token boundaries as bits of big integers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

#: What stands before the parts; shares, in percent, of texts that stay plain and of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SUFFIX_FIRST = 10, 20
SEED = 1
#: By byte: 1 for a letter of ASCII, 0 for all else.
LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))


def starts(text: str) -> int:
    """An integer whose bit i is set if a token (a run of ASCII letters, or one other character) starts at character i."""
    if not text:
        return 0
    # A byte for each character, those beyond one byte as question marks; the last character is the highest bit.
    letters = int(text.encode("latin-1", "replace").translate(LETTERS)[::-1], 2)
    return ((1 << len(text)) - 1) & ~(letters & letters << 1)


def place(bits: int, width: int, rank: int) -> int:
    """The place of the set bit (of `width` bits) that has `rank` set ones below it; the width if there are no more.

    Half of what is left goes with each step, so the work is proportional to the width."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def draws(key, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 of an id (null: of nothing)."""
    raw = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(raw[i : i + 4]) for i in range(0, 16, 4)]


def transformed(text: str, key, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, characters of the prefix and of the middle (null if plain), and the text in this form."""
    bits, (a, b, c, d) = starts(text), draws(key, seed)
    n = bits.bit_count()
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= 100 - PLAIN:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    i, j = place(bits, len(text), low), place(bits, len(text), high)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if d % 100 < SUFFIX_FIRST:
        return n, "spm", i, j - i, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", i, j - i, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars, output.

    What is drawn depends on the seed and the decimal id alone: repeated ids are cut alike, and a null id counts as an empty
    one. A null text counts as empty; empty texts and those that hold one of the marks stay plain, so that a mark in an output
    that isn't plain is always ours. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches):
        for b in batches:
            rows = [transformed(t.as_py() or "", k.as_py(), seed) for k, t in zip(b.column(0), b.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text, from its output and form alone."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def query(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM t),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
