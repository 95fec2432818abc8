"""BPE encoding and decoding by forced boundaries."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

#: Unicode White_Space beyond one byte, which the tokenizer's pattern takes for white space too.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes behind which no cut is made (white space, which the pattern may give to what follows; the apostrophe), and before
#: which none is made (the apostrophe; bytes that go on with a character).
AFTER, BEFORE = b"\t\n\x0b\x0c\r '", b"'" + bytes(range(128, 192))
#: Fragments that a worker keeps; a full cache goes on with those of the last texts. Longer fragments are not kept.
CACHED, CACHED_BYTES = 400_000, 64
#: Characters of texts that are encoded together; bytes of new fragments that the tokenizer is given as one text.
TOGETHER, JOINED = 1 << 20, 1 << 14


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, turned round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizer in a file does.

    A cut is certain between two bytes that stand together in no token of the vocabulary, as no merge crosses it. It must
    not change how the pattern before the merges splits what follows either: that looks back at nothing but a blank or an
    apostrophe in front, and ahead only from white space, so no cut is made behind white space or beside an apostrophe, nor
    within a character. Each fragment is encoded once while it is in the cache, and the ids are joined. New fragments of some
    texts are encoded in a row, as one text with a byte between them that no token holds beside another: a call for each costs more
    than its merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark's tasks have the cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        vocab = held["model"]["vocab"] | self.special
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        joined = bytearray(65536)
        for token, i in vocab.items():
            raw = token.encode() if token in self.special else bytes(alphabet[c] for c in token)
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:]):  # noqa: B905
                joined[a << 8 | b] = 1
        pairs = np.frombuffer(bytes(joined), np.uint8).reshape(256, 256).copy()
        pairs[list(AFTER), :] = 1
        pairs[:, list(BEFORE)] = 1
        #: By pair of bytes (the first times 256): whether a cut between them is certain.
        self.cut = pairs.reshape(-1) == 0
        self.length = np.array([len(b) for b in self.bytes_of])
        # A byte that stands beside no other in any token.
        last, first = np.setdiff1d(np.arange(256), list(AFTER)), np.setdiff1d(np.arange(256), list(BEFORE))
        free = [c for c in range(1, 127) if c not in AFTER and (pairs[last, c] == 0).all() and (pairs[c, first] == 0).all()]
        self.separator = bytes(free[:1]) or None
        self.cache: dict[bytes, bytes] = {}

    def fragments(self, text: str) -> list[bytes]:
        """The text in UTF-8 between its certain cuts."""
        raw = text.encode()
        if len(raw) < 2:
            return [raw] if raw else []
        x = np.frombuffer(raw, np.uint8).astype(np.uint16)
        at = np.flatnonzero(self.cut[x[:-1] << 8 | x[1:]]) + 1
        if WIDE_SPACE.search(text):
            at = at[~np.isin(at, self._wide_ends(text))]
        at = [0, *at.tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    @staticmethod
    def _wide_ends(text: str) -> np.ndarray:
        """Where white space of several bytes ends."""
        out, chars, done = [], 0, 0
        for m in WIDE_SPACE.finditer(text):
            done += len(text[chars : m.end()].encode())
            chars = m.end()
            out.append(done)
        return np.array(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of each text; some are taken together."""
        held, size = [], 0
        for t in texts:
            held.append(self.fragments(t))
            size += len(t)
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[list[bytes]]) -> list[bytes]:
        cache, parts = self.cache, set(chain.from_iterable(texts))
        missing = parts.difference(cache)
        if missing:
            cache.update(self._new(list(missing)))
        out = [b"".join(map(cache.__getitem__, t)) for t in texts]
        if len(cache) > CACHED:
            self.cache = cache = {p: cache[p] for p in parts} if len(parts) <= CACHED // 2 else {}
        for p in [p for p in missing if len(p) > CACHED_BYTES]:
            cache.pop(p, None)
        return out

    def _alone(self, part: bytes) -> bool:
        """Whether what stands beside the separator could change how the fragment is split: a text's first or last one may be so."""
        return self.separator is None or part[0] in BEFORE or part[-1] in AFTER or part[-1] >= 128 and bool(WIDE_SPACE.match(part.decode()[-1]))

    def _new(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Fragments and their ids."""
        alone = [p for p in parts if self._alone(p)]
        for p in alone:
            yield from self._row([p])
        if len(alone) == len(parts):
            return
        parts = [p for p in parts if not self._alone(p)] if alone else parts
        rows = np.cumsum([len(p) for p in parts]) // JOINED
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])).tolist()
        for i, j in zip(starts, [*starts[1:], len(parts)], strict=True):
            yield from self._row(parts[i:j])

    def _row(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        whole = (self.separator or b"").join(parts)
        ids = np.array(self.encode_batch([whole.decode()], add_special_tokens=False)[0].ids, dtype="<u4")
        at, lengths = np.append(0, np.cumsum(self.length[ids])), np.array([len(p) for p in parts])
        start = np.append(0, np.cumsum(lengths + 1)[:-1])
        i, j = np.searchsorted(at, start), np.searchsorted(at, start + lengths)
        if at[-1] != len(whole) or (at[i] != start).any() or (at[j] != start + lengths).any():
            raise ValueError("a token crosses a cut")
        raw = ids.tobytes()
        return zip(parts, [raw[a:b] for a, b in zip((4 * i).tolist(), (4 * j).tolist(), strict=True)], strict=True)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `ids` the ids as array<int>.

    The file is read by each worker from `path`, which the tokenizer's package has on every machine. A null text counts
    as empty (no tokens, hashes of nothing); repeated rows each get theirs; other columns are not read.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, digest, back, raw = [], [], [], []
            for e in c.encode_all(t.as_py() or "" for t in batch.column(1)):
                n.append(len(e) // 4)
                digest.append(hashlib.sha256(e).hexdigest())
                back.append(hashlib.sha256(c.decode(e).encode()).hexdigest())
                if ids:
                    raw.append(e)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            if ids:
                ends = pa.array(np.cumsum([0, *n]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"), ids=False)
