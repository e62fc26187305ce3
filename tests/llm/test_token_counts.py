import random

import corpus_cases as cases
import public_tokenizers
import pytest

from prepwright.llm import token_counts
from prepwright.llm.catalog import EDITS

WHERE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["foo", " ", "  ", "\n", "'s", "'re", "bar9", "12", " é", ".", "!?", " the", "ll", "'", "漢字", "😀", "\t\t"]


@pytest.fixture(scope="module")
def encoder():
    return token_counts.encoder_of(*WHERE)


def full(encoder, text):
    return len(encoder.encoding.encode_ordinary(text))


def test_edits_give_the_count_of_the_edited_text(encoder):
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 500)))
        tree = token_counts.tree_of(text, encoder)
        assert tree.tokens == full(encoder, text)
        for _ in range(4):
            a = rng.randint(0, len(text) + 3)
            b, by = a + rng.choice([0, 1, 3, rng.randint(0, 600)]), "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 1, 200])))
            wanted = text[:a] + by + text[b:]
            text, tree, _ = token_counts.edited(text, tree, a, b, by, encoder)
            assert text == wanted and tree.chars == len(text) and tree.tokens == full(encoder, text)
            assert sum(c for c, _ in tree.leaves()) == len(text) and sum(t for _, t in tree.leaves()) == tree.tokens


def test_only_the_region_of_an_edit_is_encoded_again(encoder):
    text = cases.sentence(random.Random(2), 20_000)
    tree = token_counts.tree_of(text, encoder)
    _, _, again = token_counts.edited(text, tree, 50_000, 50_003, "xyz", encoder)
    assert again < 1_000


def brute(text, edits):
    moved, past = 0, 0
    for e in sorted(edits or [], key=lambda e: (e["start"], e["end"])):
        a, b = max(e["start"], past), max(e["end"], past)
        new = text[:max(a + moved, 0)] + (e["text"] or "") + text[max(b + moved, 0):]
        moved, past, text = moved + len(new) - len(text), b, new
    return text


def test_documents(spark, encoder):
    docs = cases.frame(spark).selectExpr("doc_id", "coalesce(text, '') as text", "source", "lang", "'mine' as leaf_chars", "'mine' as n_edits").selectExpr(
        "*", f"{EDITS} as edits")
    rows = docs.collect()
    found = token_counts.recounted(token_counts.trees(docs, *WHERE), *WHERE).collect()

    def wanted(r):
        after = brute(r["text"], r["edits"])
        return str(r["doc_id"]), full(encoder, r["text"]), full(encoder, after), len(after), 3
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_tokens_after"], r["n_chars_after"], r["n_edits"]) for r in found) == sorted(map(wanted, rows))


def test_missing_texts_and_edits(spark, encoder):
    schema = "doc_id bigint, text string, edits array<struct<start: int, end: int, text: string>>"
    rows = [(1, None, None), (2, "abc def", None), (3, None, [(0, 0, "new text")]), (4, "one two three", [(4, 7, None), (90, 95, " end")]),
            (5, "one two three", [(4, 9, "x"), (2, 6, "y")])]
    docs = spark.createDataFrame(rows, schema)
    found = {r["doc_id"]: r for r in token_counts.recounted(token_counts.trees(docs, *WHERE), *WHERE).collect()}
    texts = {1: "", 2: "abc def", 3: "new text", 4: "one  three end"}
    for i in (1, 2, 3, 4):
        assert found[i]["n_tokens_after"] == full(encoder, texts[i]) and found[i]["n_chars_after"] == len(texts[i])
    after = brute("one two three", [{"start": a, "end": b, "text": t} for a, b, t in rows[4][2]])
    assert found[5]["n_tokens_after"] == full(encoder, after)
    assert token_counts.recounted(token_counts.trees(docs.limit(0), *WHERE), *WHERE).count() == 0
