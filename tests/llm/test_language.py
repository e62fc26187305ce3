import random
import zlib

import corpus_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from prepwright.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.learn(docs)


def test_held_out_accuracy(spark, docs, model):
    found = language.predicted(docs, model, carry=("doc_id", "lang", "source")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    tried = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert len(tried) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in tried]) > 0.97


def test_only_text_and_label_of_rows_that_are_not_held_out_are_learned_from(spark, docs, model):
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))) \
        .withColumn("source", F.lit("other"))
    again = language.learn(spoiled)
    assert again.languages == model.languages and np.array_equal(again.features, model.features)


def test_mixed_text_is_labelled_in_spans(docs, model):
    rows = docs.filter("n_chars between 400 and 1500 and lang in ('de', 'es')").orderBy("doc_id").collect()
    german, spanish = (next(r["text"] for r in rows if r["lang"] == k) for k in ("de", "es"))
    text = german + "\n" + spanish
    lang, score, spans = language.labelled(text, model)
    assert [s["lang"] for s in spans] == ["de", "es"]
    assert abs(spans[1]["start"] - len(german)) < 40 and 0.2 < score < 0.8
    assert lang == ("de" if len(german) > len(spanish) else "es")


def test_viterbi_finds_a_best_path():
    rng = np.random.default_rng(5)

    def value(path, scores, switch):
        return scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()
    for n in (1, 2, 5, 7):
        for _ in range(60):
            scores, switch = rng.normal(size=(n, 3)) * 3, rng.choice([0.5, 3.0, 9.0])
            best = max(value(np.array(p), scores, switch) for p in np.ndindex(*[3] * n))
            assert value(language.viterbi(scores, switch), scores, switch) == pytest.approx(best)


def test_scripts_narrow_the_candidates(spark):
    latin, greek = "the cat sat on the mat and that was all", "και το παιδί είναι εδώ με τον άλλο"
    rows = [(i, latin if i % 2 else greek, "en" if i % 2 else "el") for i in range(40)]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert language.labelled("ζζζζ ψψψ ξξξ", model)[0] == "el" and language.labelled("zzz qqq xxx", model)[0] == "en"


def test_cases(spark, model):
    rows = cases.documents()
    docs = cases.clashing(cases.frame(spark, rows), "spans", "score", "held_out")
    found = language.predicted(docs, model, carry=tuple(docs.columns)).collect()
    assert len(found) == len(rows)
    for r in found:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter) and 0 <= r["score"] <= 1
    assert language.predicted(cases.frame(spark, []), model).count() == 0
    nothing = language.learn(cases.frame(spark, []))
    assert {r["lang_pred"] for r in language.predicted(cases.frame(spark, rows[:3]), nothing).collect()} == {"und"}


def test_long_texts_are_scored_in_pieces(model, monkeypatch):
    rng = random.Random(3)
    text = cases.sentence(rng, 3_000) + "İstanbul ẞ " * 5
    whole = language.labelled(text, model)
    monkeypatch.setattr(language, "PIECE", 100)
    assert language.labelled(text, model) == whole
