import compare
import corpus_cases as cases
import pytest
import test_decontaminate
import test_lines
import test_simhash

import corpus_pipeline
from prepwright.llm import catalog, language, lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_queries_agree_with_their_oracle(spark, key):
    assert compare.difference(catalog.QUERIES[key](spark, SF), compare.oracle(SF), catalog.ORACLE[key]) is None


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_have_a_row_for_each_document(spark, key):
    assert catalog.QUERIES[key](spark, SF).select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def without_lines(rows):
    """What the stage lines leaves: long lines within one edit of an earlier one go, and exact repeats of short ones unless blank."""
    seen, out = set(), []
    for doc, _, n, text in test_lines.brute(rows, 1, lines.MIN_CHARS):
        kept = []
        for line in text.split("\n") if text else []:
            short = len(line) < lines.MIN_CHARS and line.strip()
            if short and line in seen:
                n += 1
            else:
                kept.append(line)
            if short:
                seen.add(line)
        out.append((doc, n, "\n".join(kept)))
    return [(doc, text) for doc, n, text in out if not n or text.strip()]


def brute(rows, items, model):
    """What is left after four stages, of rows (doc_id, text) with distinct ids in order."""
    rows = [(d, t) for d, t in rows if t and language.labelled(t, model)[0] != "und" and language.labelled(t, model)[1] >= corpus_pipeline.MIN_SCORE]
    rows = without_lines(rows)
    prints = {d: test_simhash.brute_fingerprint(t) for d, t in rows}
    roots, first = test_simhash.brute_roots(set(prints.values()), 4), {}
    for d, _ in rows:
        first.setdefault(roots[prints[d]], d)
    rows = [(d, t) for d, t in rows if first[roots[prints[d]]] == d]
    clean = {d for (d, _, hit, _) in test_decontaminate.brute(rows, items, 10) if not hit}
    return [(d, t) for d, t in rows if d in clean]


def test_pipeline_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["decoded"]) for r in found.collect()) == [(d, t.replace("▁", " ")) for d, t in brute(rows, items, model)]


def test_stages_keep_the_columns_and_take_all_cases(spark):
    docs = cases.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, cases.frame(spark, []), cases.clashing(docs, "ats", "text_hash", "spans", "n_removed", "key", "n_chars")):
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            assert out.count() <= df.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
