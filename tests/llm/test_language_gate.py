import corpus_pipeline
from prepwright.llm import language

SF = "/root/testdata/sf0.01"


def test_mixtures_and_unknown_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    some = docs.filter("n_chars between 600 and 1500").orderBy("doc_id").collect()
    parts = {}
    for r in some:
        if r["lang"] in model.languages and language.labelled(r["text"], model)[:2] == (r["lang"], 1.0):
            parts.setdefault(r["lang"], r["text"][:400])
    a, b, c = (parts[k] for k in sorted(parts)[:3])
    cyrillic, greek, han = "мама мыла раму и пошла домой " * 9, "και το παιδί είναι εδώ με τον άλλο " * 9, "天地玄黄宇宙洪荒" * 20
    rows = docs.limit(0).columns
    texts = {1: a, 2: a + "\n" + a + "\n" + b, 3: a + "\n" + cyrillic[:80],
             11: a + "\n" + b + "\n" + c, 12: cyrillic, 13: greek, 14: han, 15: a[:100] + "\n" + cyrillic, 16: "12 34"}
    made = spark.createDataFrame([(-i, t, None, "s", len(t)) for i, t in texts.items()], docs.select(*rows).schema)
    kept = corpus_pipeline.by_language(spark, docs.unionByName(made), SF).filter("doc_id < 0").collect()
    assert sorted(-r["doc_id"] for r in kept) == [1, 2, 3]
    assert language.labelled(cyrillic, model)[0] in model.languages and language.labelled(cyrillic, model)[1] == 0.0
    assert language.labelled(a + "\n" + b + "\n" + c, model)[1] > 0.3
