import random

import pytest

import corpus_pipeline
from homolith.llm import bpe, jaccard, mixing, pii, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def write(spark, folder, rows, labels):
    docs = [(i, t, "en", s, len(t) if t is not None else None, "x") for i, t, s in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choices(("th", "er", "on", "an", "re"), k=draw.randint(1, 4)))
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(draw.randint(30, 80))]
        if i % 5 == 0:
            w[draw.randrange(len(w))] = draw.choice(("fiend", "wretch", "ghoul"))
            w[draw.randrange(len(w))] = draw.choice(("fiend", "wretch", "ghoul"))
        rows.append((i, " ".join(w), f"s{i % 3}" if i % 7 else None))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(40):  # exact and near copies of clean documents
        w = rows[i + 1 if i % 5 == 0 else i][1].split()
        rows.append((1000 + i, " ".join(w if i % 2 else [*w, "more"]), "s0"))
    rows += [(2000, "write to a@b.c or 4111 1111 1111 1111 now", "s1"), (2001, None, "s1"), (2002, "", None), (None, "some words of a document without a name", "s2"), (2003, rows[1][1] + " " + rows[2][1] * 40, "s2")]
    return rows, labels


def test_stages_do_their_work(spark, tmp_path):
    rows, labels = corpus()
    write(spark, str(tmp_path), rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {i for i, _, y in labels if y}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "pii", "mixing", "bpe"]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        held[name] = (docs, spark.read.parquet(path))
        docs = held[name][1]
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)
    before, after = (set(ids(x)) for x in held["toxicity"])
    gone = before - after
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.03 * len(before - toxic)
    before, after = held["ngram_jaccard"]
    linked = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.linked(before, 5, 80).collect()}
    want = {c for _, c, n in linked if n and c is not None} | {i for i, _, n in linked if not n} | {None}
    assert set(ids(after)) == want and after.count() == len(want)
    before, after = held["pii"]
    assert after.count() == before.count()
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert text[2000] == ("write to <EMAIL> or <CARD> now", 30) and text[2001] == (None, None) and text[2002][0] == ""
    before, after = held["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.planned(before).collect()}
    assert sorted(ids(after), key=repr) == sorted([i for i, n in plan.items() for _ in range(n)], key=repr)
    before, after = held["bpe"]
    codec = bpe.codec(bpe.default_path())
    assert after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and after.count() == before.count()
    t = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["ids"] == list(memoryview(codec.encode(t[r["doc_id"]] or "")).cast("I")) for r in after.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, after.collect()))


@pytest.mark.parametrize("rows", [[], [(None, None, None)] * 3, [(1, "one", "a"), (1, "one", "a"), (None, " ", None)]])
def test_odd_tables(spark, tmp_path, rows):
    write(spark, str(tmp_path), rows, [(1, None, None)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {t for _, t, _ in rows}
    assert len(out) <= 3 * len(rows) and (not rows or len(out) >= len(texts))
