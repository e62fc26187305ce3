import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_cases import clashing, documents, frame
from prepwright.llm import alignment
from prepwright.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PATHS = P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) with the libraries and token by token."""
    a_lib = Tokenizer.from_file(PATHS[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    byte_of = alignment._byte_of()
    a_raw = lambda i: bytes(byte_of[c] for c in a_lib.id_to_token(i))
    b_raw = lambda i: bytes([int(b_lib.id_to_piece(i)[1:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for doc_id, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(map(a_raw, a)) != whole or b"".join(map(b_raw, b)) != whole:
            a, b = [], []
        spans = []
        for ids, raw in ((a, a_raw), (b, b_raw)):
            at, side = 0, []
            for i in ids:
                side.append((at, at + len(raw(i)), i))
                at += len(raw(i))
            spans.append(side)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s < high) for side in spans))
            low = high
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e] if len(a) < 3000 else []
        docs.append((doc_id, a, b, ";".join(groups), len(both), links))
    counts = Counter(p for d in docs for p in set(d[5]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted(((d, len(a), len(b), n, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), g)
                   for d, a, b, g, n, links in docs), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))
                   for r in alignment.weighed(alignment.alignments(df, *PATHS)).collect()), key=repr)


CASES = [(1, "<|endoftext|> and <s>, </s>, <0x0A> stay text"), (2, "tab\tand\r\nbreak\x0b\x00 \x1c end  "), (3, "▁ becomes a space"),
         (4, "漢字かな 😀 İstanbul ﬁne Ünïcödé"), (5, None), (6, ""), (7, " "), (8, "x"), (9, "a" * 700), (10, "the cat"), (10, "the cat"),
         (None, "the cat sat"), (11, "é   nbsp 　"), (12, "12345678901234567890 3.14")]


def test_agrees_with_brute_force(spark):
    rng = random.Random(3)
    noise = [(100 + i, "".join(rng.choice("ab cdé漢\n1,.  ") for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows = CASES + noise + [(r[0], r[1]) for r in documents() if not r[1] or len(r[1]) < 4000]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = CASES + [(r[0], r[1]) for r in documents(count=20) if not r[1] or len(r[1]) < 4000]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    whole = alignment.alignments(df, *PATHS).collect()
    both = alignment.tokenizers(*PATHS)
    texts = [t or "" for _, t in rows]
    apart = [x for t in texts for x in alignment._aligned([t], both)]
    together = alignment._aligned(texts, both)
    assert [r[:4] for r in apart] == [r[:4] for r in together]
    assert all((a[4] == b[4]).all() for a, b in zip(apart, together))
    assert [(r["n_a"], r["groups"]) for r in whole if r["pairs"] is None] == [(r[0], r[3]) for r in together]


def test_every_overlap_lies_in_a_group():
    rng = np.random.default_rng(5)
    for _ in range(200):
        ends = [np.unique(np.append(rng.integers(1, 40, rng.integers(1, 20)), 40)) for _ in range(2)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        groups = alignment.coalesced(starts[0], ends[0], starts[1], ends[1])
        cuts = np.intersect1d(*ends)
        for g, s in zip(groups, starts):
            assert (g == np.searchsorted(cuts, s, "right")).all()
        left, right = alignment.overlaps(starts[0], ends[0], starts[1], ends[1])
        every = [(i, j) for i in range(len(starts[0])) for j in range(len(starts[1]))
                 if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert list(zip(left.tolist(), right.tolist())) == every
        assert (groups[0][left] == groups[1][right]).all()


def test_long_runs_of_blanks():
    tokens = alignment.ByteTokens(*PATHS[:2])
    text = "a" + " " * 200_000 + "b"
    assert tokens.encode(text) == tokens.whole.encode(text, add_special_tokens=False).ids


def test_vocabulary_is_that_of_the_library():
    tokens = alignment.ByteTokens(*PATHS[:2])
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x3000, 0x30FF), 10, 32]))
                     for _ in range(60)) for _ in range(500)]
    assert [tokens.encode(t) for t in texts] == [e.ids for e in tokens.whole.encode_batch(texts, add_special_tokens=False)]


def test_empty_clashing_and_query(spark):
    assert found(frame(spark, [])) == []
    df = frame(spark, documents(count=8)[:8])
    named = clashing(df, "n_a", "groups", "links", "block", "pairs", "place")
    kept = alignment.weighed(alignment.alignments(named, *PATHS, carry=("doc_id", "n_a", "place")))
    assert "place" in kept.columns and kept.filter("n_a > 0").count() == df.filter("length(text) > 0").count()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(d, t) for d, t in rows]
    query = QUERIES["op12_token_alignment"](spark, SF)
    assert [c for c in query.columns] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    real = {r["doc_id"]: r for r in query.collect()}
    assert len(real) == len(rows)
    for r in alignment.weighed(alignment.alignments(spark.read.parquet(f"{SF}/documents.parquet"), *PATHS)).collect():
        digest = hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else ""
        assert (real[r["doc_id"]]["groups_sha256"], real[r["doc_id"]]["count_sum"]) == (digest, r["count_sum"])
    assert not query.filter(F.col("n_links") < F.col("n_best")).count()
