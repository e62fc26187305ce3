import corpus_cases as cases

import corpus_pipeline
from prepwright.llm import catalog, lines

SF = "/root/testdata/sf0.001"


def test_exact_repeats_of_short_lines_go(spark):
    near = "a line of more than twenty characters"
    rows = [(1, "Home\n\n  \nx\n" + near), (2, "Home\n\n  \nHome.\nx"), (3, "home\n" + near + "!\nHome"), (None, "x")]
    found = lines.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), short=True).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in found} == {
        None: (1, 0, "x"), 1: (5, 1, "Home\n\n  \n" + near), 2: (5, 2, "\n  \nHome."), 3: (3, 2, "home")}


def test_query_and_stage_leave_no_short_repeat(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    seen, wanted = set(), {}
    for r in docs.collect():
        short = [x for x in (r["text"] or "").split("\n") if x.strip() and len(x) < lines.MIN_CHARS]
        wanted[r["doc_id"]] = sum(x in seen or x in short[:i] for i, x in enumerate(short))
        seen.update(short)
    assert sum(wanted.values()) > 50
    found = catalog.QUERIES["op9_line_dedup"](spark, SF).collect()
    longer = {r["doc_id"]: r["n_removed"] for r in lines.without_repeats(docs).collect()}
    assert {r["doc_id"]: r["n_removed"] - longer[r["doc_id"]] for r in found} == wanted
    left = [x for r in corpus_pipeline.by_line(spark, docs, SF).collect() for x in (r["text"] or "").split("\n") if x.strip()]
    short = [x for x in left if len(x) < lines.MIN_CHARS]
    assert len(short) == len(set(short))


def test_short_lines_of_all_cases(spark):
    rows = [(5, "Menu"), (5, "Menu"), (6, None), (7, "Menu\nMenu"), (8, "")]
    found = lines.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), short=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in found if r["text"] is not None) == [
        (5, 0, "Menu"), (5, 0, "Menu"), (7, 2, ""), (8, 0, "")]
    assert lines.without_repeats(cases.frame(spark, []), short=True).count() == 0
