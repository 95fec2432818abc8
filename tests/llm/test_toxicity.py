import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from homolith.llm import toxicity

WORDS = ("th", "er", "on", "an", "re")


def corpus(n=600, seed=6):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(draw.choices(WORDS, k=draw.randint(1, 4))) for _ in range(draw.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            w[draw.randrange(len(w))] = draw.choice(("fiend", "wretch", "ghoul"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, g string, h long, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def counted(cells):
    """Contexts from the cells that they fill, level by level."""
    lc = [-64 * math.log(1 - min(sum(x // 64 == j for x in cells), 63.5) / 64) for j in range(5)]
    full = [sum(x // 64 == j for x in cells) > 60 for j in range(4)]
    j = next((j for j in range(4) if not full[j]), 4)
    return 8**j * sum(lc[j:])


def test_contexts_of_any_number(spark):
    """Levels by definition, and counts that don't stop: within a few of the truth for rare expressions, a fifth or so for common ones."""
    for w in ("", "a", "é", "word17"):
        h = xxhash.xxh64_intdigest(w, 7)
        level = next((j for j in range(4) if h >> 6 + 3 * j & 7), 4)
        assert toxicity.cell_of(w) == 64 * level + h % 64
    for n, off in ((1, 0.02), (5, 0.3), (30, 0.35), (120, 0.45), (2000, 0.6), (40_000, 0.6), (500_000, 0.7)):
        assert abs(counted({toxicity.cell_of(f"c{n}-{i}") for i in range(n)}) / n - 1) < off
    name = lambda i: "w" + "".join(chr(97 + int(x)) for x in str(i))
    rows = [(i, f"{name(i % 7)} common {name(i)} rare") for i in range(900)]
    docs, _ = frames(spark, rows, [(0, 0)])
    table = toxicity.counted(docs.selectExpr("text", "0 AS toxic", "CAST(doc_id % 4 AS INT) AS fold"))
    got = {r["g"]: r["k"] for r in table.select("g", toxicity.contexts().alias("k")).collect()}
    assert got["common"] == pytest.approx(counted({toxicity.cell_of(name(i)) for i in range(7)})) and got["rare"] == pytest.approx(counted({toxicity.cell_of(name(i)) for i in range(900)}))
    assert 450 < got["rare"] < 1500


def by_hand(rows, labels):
    """Log ratio of every expression, straight from the formula."""
    toxic, n, cells, seen = dict(labels), [Counter(), Counter()], defaultdict(set), set()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 3 == 1 or t in seen:
            continue
        seen.add(t)
        words = t.split()
        n[toxic[i]].update(set(words))
        for a, b in zip(["", *words], words):
            cells[b].add(toxicity.cell_of(a))
    k = {w: counted(c) for w, c in cells.items()}
    total, free, off = sum(k.values()), [], []
    for c in n:
        of = [max(sum(v == j for v in c.values()), 1) for j in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        d = [0, *(min(max(j - (j + 1) * y * of[j] / of[j - 1], 0.1), j - 0.02) for j in (1, 2, 3))]
        off.append(d)
        free.append(sum(d[min(v, 3)] if v < 3 else d[3] for v in c.values()) / sum(c.values()))
    p = lambda w, c: (n[c][w] - off[c][min(n[c][w], 3)]) / sum(n[c].values()) + free[c] * k[w] / total
    for c in (0, 1):
        assert abs(sum(p(w, c) for w in k) - 1) < 0.02  # a number of kinds of 0 counts as 1
    return {w: math.log(p(w, 1) / p(w, 0)) for w in k}, math.log(free[1] / free[0])


def test_probabilities_by_hand(spark):
    rows, labels = corpus(400)
    docs, lab = frames(spark, rows, labels)
    want, new = by_hand(rows, labels)
    model = toxicity.train(docs, lab)
    words = sorted(want)
    assert len(model.hashes) == len(words)
    assert np.allclose(model.look_up(words), [want[w] for w in words], atol=0.05)
    assert abs(model.look_up(["unheard"])[0] - new) < 0.05


def test_scores(spark):
    rows, labels = corpus()
    long = " ".join(t for _, t in rows) * 8
    docs, lab = frames(spark, [*rows, (7000, None), (7001, ""), (7002, long), (7003, rows[0][1]), (7003, rows[0][1]), (None, rows[0][1])], [*labels, (None, 1), (1, None), (2, 0), (2, 1)])
    model = toxicity.train(docs, lab)
    out = toxicity.scored(docs, model)
    assert out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    right = [got[i]["predicted"] == t for i, t in labels if i in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.95
    assert got[7000]["score"] == got[7001]["score"] and got[7000]["predicted"] == 0 and not got[None]["held_out"]
    assert got[7003]["score"] == got[0]["score"] == got[None]["score"]
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in out.collect())
    # A table of ratios that is too large to broadcast is joined: the same scores.
    joined = toxicity.train(docs, lab, most=0)
    assert joined.path and not len(joined.hashes)
    other = {(r["doc_id"], r["score"]) for r in toxicity.scored(docs, joined).collect()}
    assert {(i, round(v, 9)) for i, v in other} == {(r["doc_id"], round(r["score"], 9)) for r in out.collect()}
    assert sorted(map(repr, toxicity.keep_ordinary(docs, joined).collect())) == sorted(map(repr, kept.collect()))


def test_empty_and_unlabelled(spark):
    rows, labels = corpus(40)
    docs, lab = frames(spark, rows, labels)
    for given in (lab.limit(0), lab.filter("toxic = 0")):
        model = toxicity.train(docs, given)
        assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {0.5}
        assert toxicity.keep_ordinary(docs, model).count() == len(rows)
    model = toxicity.train(docs.limit(0), lab)
    assert toxicity.scored(docs.limit(0), model).count() == toxicity.keep_ordinary(docs.limit(0), model).count() == 0


def test_reads_whole_runs():
    run = "天地人" * 30
    assert toxicity.expressions(run + "惡鬼")[-1] == "惡鬼" and len(toxicity.expressions(run + "惡鬼")) == len(run) + 1
    assert toxicity.expressions("One two, THREE4é") == ["one", "two", "three", "é"]
    glued = toxicity.expressions("x" * 30 + "wretched")
    assert "wretched" in glued and len(glued) == 31
    assert toxicity.expressions("") == [] and toxicity.expressions("12 _ 3") == []


@pytest.mark.parametrize("value", [0.0, 1.0])
def test_cut_has_the_threshold(value):
    x = np.array([[v] for v in range(20)], float)
    w = toxicity.fitted(x, (x[:, 0] > 14).astype(float))
    score = 1 / (1 + np.exp(-(w[0] + w[1] * x[:, 0])))
    assert ((score >= toxicity.THRESHOLD) == (x[:, 0] > 14)).all()
