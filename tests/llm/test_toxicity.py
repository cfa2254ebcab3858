import random

from helpers_llm import docs

from lodgetrail.llm import toxicity

CLEAN = "the quick brown fox jumps over a lazy dog while seven kind wizards make toxic free jam for their friends".split()
BAD = ["zgrumble", "vexiphor", "quorblat"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD).upper()
        out.append(" ".join(words))
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_texts_are_told_apart(spark):
    texts = corpus(240, 1)
    model = toxicity.fit(docs(spark, texts), labels(spark, [(i, int(i % 4 == 0)) for i in range(160)]))
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, texts), model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(160, 240))
    assert all(0 <= s <= 1 for s in got.values())


def test_edges_have_scores_and_columns_stay(spark):
    model = toxicity.fit(docs(spark, corpus(80, 2)), labels(spark, [(i, int(i % 4 == 0)) for i in range(80)] + [(1, None), (None, 1), (5, 7)]))
    table = docs(spark, ["", None, "a", "vexiphor " * 20000, "the quick", "the quick", "日本 \x00\x00"]).withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    rows = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert rows[0].score == rows[1].score and rows[4].score == rows[5].score and rows[3].score > 0.7
    assert set(table.columns) == set(rows[0].asDict()) and rows[1].text is None and rows[0].label == "src0"


def test_one_kind_of_label_none_or_no_rows(spark):
    table = docs(spark, corpus(20, 3))
    for rows, low, high in (([(i, 0) for i in range(20)], 0, 0.1), ([(i, 1) for i in range(20)], 0.9, 1), ([], 0.5, 0.5)):
        scores = {r.score for r in toxicity.score(table, toxicity.fit(table, labels(spark, rows))).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high
    model = toxicity.fit(docs(spark, []), labels(spark, []))
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_slices_don_t_matter(spark, monkeypatch):
    texts = corpus(60, 4)
    model = toxicity.fit(docs(spark, texts), labels(spark, [(i, int(i % 4 == 0)) for i in range(60)]))
    place, width = model.place(), len(model.weights)
    whole = toxicity._present(texts, place, width)
    assert (whole == [toxicity._present([t], place, width)[0] for t in texts]).all()
