import random

import corpus_pipeline

from tessera.llm import decontaminate, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    now, ids = docs, {d["doc_id"] for d in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert left <= ids
        if name == "language":
            assert not left & {0, 1, 2, 5} and 6 in left
        if name == "near_duplicates":
            assert 6 in left and 106 not in left and now.count() == len(left)
        if k < 4:
            assert now.columns == docs.columns
        ids = left
    assert "n_tokens" in now.columns


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.6 * n < got.count() < n


def test_rows_without_an_own_id_go_for_their_text_alone(spark):
    r = random.Random(17)
    made = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts, item = [made(60) for _ in range(8)], made(30)
    leak = made(20) + " " + item
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (9, texts[4]), (5, texts[5]), (6, texts[5]), (6, texts[5]), (10, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(x["text"] for x in kept.collect()) == sorted(texts[:6])
    assert {x["doc_id"] for x in kept.collect() if x["text"] == texts[5]} == {5}
    rows = [(None, texts[0]), (None, leak), (3, leak), (3, texts[6]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {x["text"] for x in decontaminate.clean(docs, bench).collect()} == {texts[0], texts[6], None}


def test_stages_on_an_empty_table_and_without_ids(spark, empty):
    now = empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == empty.columns and now.count() == 0, name
    assert corpus_pipeline.tokens(spark, empty, SF).count() == 0
    r = random.Random(5)
    made = lambda: " ".join(r.choice(["the", "of", "and", "stone", "river", "walks"]) + r.choice("aeiou") for _ in range(40))
    texts = [made() for _ in range(6)]
    rows = [(None, t, "en", "s", 1) for t in [*texts, texts[0], None, "", "mail a@b.co " + made()]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(x["text"] or "" for x in kept.collect()) == sorted([*texts, "", rows[-1][1]])
    assert corpus_pipeline.decontamination(spark, docs, SF).count() == len(rows)
    masked = [x["text"] for x in corpus_pipeline.personal_data(spark, docs, SF).collect()]
    assert len(masked) == len(rows) and None in masked and sum("<EMAIL>" in (t or "") for t in masked) == 1
    assert corpus_pipeline.tokens(spark, docs, SF).filter("doc_id is null").count() == len(rows)
