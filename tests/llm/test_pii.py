import hashlib
import random
import re
import time

import pytest

from homolith.llm import pii


def frame(spark, rows):
    """Columns whose names are those that the operator would like to use."""
    names = ["__pii_text", "__pii_spans", *[f"__pii_{k}" for k in pii.KINDS], "__pii_new", "kind"]
    return spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    spans = sorted((m.start(), k, m.end(), n) for k, (n, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t) if ok(m[0]))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)


def test_pii(spark):
    draw = random.Random(4)
    parts = [*"a1b2.@+-_ %()é😀", "12.3.4.5", "4111 1111 1111 1111", "+49 (0)30 123456", "a@b.c", "256.1.1.1", "00.0.0.007"]
    rows = [(i, "".join(draw.choices(parts, k=draw.randint(0, 40)))) for i in range(400)] + [(1000, None), (1001, "IBAN DE89370400440532013000 ok"), (1002, "x" * 50_000 + "@b.c " + "1" * 5000), (1003, "to DE89 3704 0044 0532 0130 00 and"), (1004, "GB82-WEST-1234-5698-7654-32"), (1005, "DE89 3704 0044 0532 0130 01")]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(brute_pii(t or "").encode()).hexdigest(), t
    assert [got[1003 + i]["spans"] for i in range(3)] == ["iban:3:30", "iban:0:27", ""]
    assert got[1001]["spans"] == "iban:5:27" and got[1001]["top_score"] == 1.0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, [(1, "mail a@b.c or +1 555 123 4567!"), (2, None), (3, "é 4111111111111111")])).collect()}
    assert clean == {1: "mail <EMAIL> or <PHONE>!", 2: None, 3: "é <CARD>"}


def test_repeats_and_empty(spark):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c"), (None, None)]
    got = pii.find(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in got) == [(0, ""), (0, "email:0:5"), (1, "email:0:5"), (1, "email:0:5")]
    assert pii.find(frame(spark, []).limit(0)).count() == pii.redact(frame(spark, []).limit(0)).count() == 0
    kept = pii.redact(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r["__pii_email"] for r in kept.collect()} == {"__pii_email"}


@pytest.mark.parametrize("unit", ["a@b.c ", "1.2.3.4 x ", "12 34 ", "é4111111111111111, +49 30 1234567;"])
def test_many_spans_in_one_text(spark, unit):
    """Blocks meet at any place of a text; time grows with its length, not with the square of its spans."""
    for n in (511, 512, 513, 1700):
        t = unit * n
        assert pii.find(frame(spark, [(1, t)])).collect()[0]["base_sha256"] == hashlib.sha256(brute_pii(t).encode()).hexdigest()
    clean = pii.redact(frame(spark, [(1, "a@b.c " * 1700 + "end")])).collect()[0]["text"]
    assert clean == "<EMAIL> " * 1700 + "end"
    began = time.time()
    pii.find(frame(spark, [(1, unit * 60_000)])).collect()
    assert time.time() - began < 30


def test_overlaps_across_blocks(spark):
    t = "+12 1.2.3.4 " * 600 + "4111 1111 1111 1111 +4111 1111 1111 1111" * 300
    spans = [tuple(s.split(":")) for s in pii.find(frame(spark, [(1, t)])).collect()[0]["spans"].split(",")]
    out, at = [], 0
    for kind, a, b in spans:
        if int(a) >= at:
            out += [t[at : int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    assert pii.redact(frame(spark, [(1, t)])).collect()[0]["text"] == "".join(out) + t[at:]
