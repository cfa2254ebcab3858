import pytest
from helpers_llm import WORD, docs, near_components, without_repeats

import corpus_pipeline
from lodgetrail.llm.queries import TOXIC, toxicity_model
from lodgetrail.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows after each stage, as the next one reads them."""
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, found[-1], SF).collect()
        found.append(spark.createDataFrame(out))
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    model = toxicity_model(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], model).collect()}
    assert set(after) == {d for d in before if scores[d] < TOXIC} and after[min(after)] == before[min(after)]


def test_one_of_each_near_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    _, component = near_components([(d, r.text) for d, r in before.items()], 80)
    assert set(after) == {d for d in before if component[d] == d}


def test_repeats_are_cut(steps):
    before, after = rows(steps[2]), rows(steps[3])
    _, kept = without_repeats([(d, r.text) for d, r in before.items()])
    assert set(after) == set(before)
    for d, r in after.items():
        assert WORD.findall(r.text) == kept[d] and r.n_chars == len(r.text)


def test_secrets_are_redacted(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(after) == set(before)
    for d, r in before.items():
        assert after[d].text == r.text or "[SECRET]" in after[d].text


def test_all_are_packed(steps):
    assert {r.doc_id for r in steps[5].collect()} == set(rows(steps[4]))
    assert steps[1].columns == steps[4].columns == steps[0].columns


def test_stages_take_empty_tables(spark):
    table = docs(spark, [])
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, table, SF)
        assert out.count() == 0
        table = table if set(corpus_pipeline.COLUMNS) - set(out.columns) else out


def test_odd_rows_go_through_all_stages(spark):
    from pyspark.sql import functions as F

    key = "0123456789abcdef0123456789abcdef01234567"
    texts = [(1, None), (1, None), (2, ""), (3, "word " * 60), (3, "word " * 60), (4, "quiet text of a few words here"), (5, f'token = "{key}"')]
    table, odd = docs(spark, texts), {n: F.lit("x") for n in ("offset", "sequence_id", "kept", "_score", "kept_text", "secret")}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, table.withColumns(odd), SF)
        found = out.collect()
        assert sorted(r.doc_id for r in found) == [1, 1, 2, 3, 3, 4, 5], name
        table = spark.createDataFrame(found, out.schema)
        if name == "secrets":
            assert {r.doc_id: r.text or "" for r in found} == {1: "", 2: "", 3: "word", 4: texts[5][1], 5: 'token = "[SECRET]"'}
    assert {r.doc_id: r.length for r in found}[1] == 1
