import random

import corpus_cases as cases
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from prepwright.llm import common, sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def mine():
    return sentencepieces.pieces(PATH)


def texts():
    rng = random.Random(1)
    signs = list("aeth  nr\n\t▁▁'.,0123é漢字😀<>/sx\x00‍　﷽ÀÿŁщיא²")
    names = [p for p in sentencepieces.pieces(PATH).names if p]
    for _ in range(1_500):
        yield "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        yield "".join(rng.choice(names) for _ in range(rng.randint(1, 12)))
        yield "".join(rng.choice([" " * rng.randint(1, 50), "a", "ing", "the"]) for _ in range(rng.randint(1, 60)))
    for n in range(120):
        yield from (" " * n, " " * n + "a", "a" + " " * n + "\n" + " " * n)
    yield from ("<s>", "</s><unk>", "<0x0A>", "▁", "a" * 5_000)


def test_ids_and_decoded_texts_are_the_library_s(library, mine):
    for text in texts():
        ids = mine.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert mine.decode(ids) == library.decode(ids.tolist()), text


def test_any_ids_decode_as_in_the_library(library, mine):
    rng = random.Random(2)
    for _ in range(3_000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(0, 259) for _ in range(rng.randint(0, 8))]
        assert mine.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_backtracking_equals_merging(mine):
    rng = random.Random(3)
    for _ in range(2_000):
        unit = "".join(rng.choice("abdehiknorst▁.") for _ in range(rng.randint(1, 14)))
        assert mine.split(unit) == mine.merged(unit)


def test_a_full_store_of_units_changes_nothing(library, mine, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_UNITS", 3)
    text = cases.sentence(random.Random(4), 200)
    assert mine.encode(text).tolist() == library.encode(text)


def test_documents(spark, library):
    rows = cases.documents()
    docs = cases.clashing(cases.frame(spark, rows), "ids", "decoded")
    found = sentencepieces.round_trips(docs, PATH, carry=tuple(docs.columns)).collect()
    wanted = [(str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in rows]
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in found) == sorted(wanted)
    assert sentencepieces.round_trips(cases.frame(spark, []), PATH).count() == 0


def test_a_worker_keeps_short_units_and_short_batches_only(spark, mine):
    word = "long" * sentencepieces.KEPT_LENGTH
    mine.encode(f"short {word}")
    assert "▁short" in mine.units and not any(word in unit for unit in mine.units)

    def sizes(batches):
        for batch in batches:
            yield {"n": [batch.num_rows], "size": [batch.nbytes]}
    docs = spark.range(3_000, numPartitions=1).selectExpr("repeat('x', 1000) as text")
    found = common.map_batches(docs, sizes, "n bigint, size bigint", sentencepieces.PORTION).collect()
    assert sum(r.n for r in found) == 3_000 and all(r.size < 1.1 * sentencepieces.PORTION for r in found)
    assert common.map_batches(docs, sizes, "n bigint, size bigint").count() < len(found)
    kept = sentencepieces.round_trips(docs, PATH, carry=()).selectExpr("sum(length(decoded)) as n", "count(*) as rows").first()
    assert (kept.n, kept.rows) == (3_000_000, 3_000)
