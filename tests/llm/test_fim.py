import hashlib
import random
import re

from homolith.llm import fim

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, " \t\n"), (5, "é😀 ab?" * 300), (None, "one two three"), (6, "has <S> in it"), (7, "x" * 200_000 + "<" + "S>"), (8, "<" * 50), (9, "P>S>M>" * 40)]


def expected(i, t):
    t = t or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    raw = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(raw[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_places_of_bits():
    draw = random.Random(2)
    for _ in range(500):
        width = draw.randint(1, 200)
        bits = draw.getrandbits(width) & draw.getrandbits(width) if draw.random() < 0.5 else draw.getrandbits(width)
        at = [i for i in range(width) if bits >> i & 1]
        assert [fim.place(bits, width, r) for r in range(len(at) + 2)] == [*at, width, width]


def test_starts():
    for t in ("", "a", "ab c", "é😀ab?cd\n\x00Z", "?" * 5, "Ab1cD"):
        at = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)]
        assert fim.starts(t) == sum(1 << i for i in at)


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = ODD + [(100 + i, "".join(draw.choice(["ab", "Z", " ", "é", "<", "P>", "😀", "\n"]) for _ in range(draw.randint(0, 60)))) for i in range(400)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, output string")
    want = sorted((expected(i, t) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in fim.fill_in_middle(frame).collect()), key=repr) == want
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {(i, t or "") for i, t in rows}
    got = fim.query(spark, str(tmp_path))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == sorted(((*w[:5], sha(w[5])) for w in want), key=repr)
    assert {(r["doc_id"], r["restored_sha256"]) for r in got.collect()} == {(i, sha(t)) for i, t in texts}
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
