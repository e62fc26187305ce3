"""Small documents with the cases every operator has to define: nulls, empty and long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = "the of and to in is that for it as was with be by on not he his but at are this have from or had".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(words))


def documents(seed: int = 7, count: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    long_line = sentence(rng, 40)
    rows = []
    for i in range(count):
        text = "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            text += "\n" + long_line
        if i % 7 == 3 and rows[-1][1]:
            text = rows[-1][1]
        if i % 11 == 5:
            words = rows[-2][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "fr", None]), f"src{i % 3}", len(text)))
    rows += [(count, None, "en", None, None), (count + 1, "", "en", "s", 0), (count + 2, " \t\n ", None, "s", 4),
             (count + 3, "1234 -- 5", "fr", "s", 9), (count + 4, sentence(rng, 6000), "en", "s", 1), (None, rows[1][1], "en", "s", 2),
             (count + 5, "Ünïcödé  wörds\r\nand\x0btabs\tİ 漢字かな 😀", "fr", "s", 3)]
    return rows + [rows[0], rows[0]]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(df, *names):
    """The frame with more columns, named like those that operators make."""
    from pyspark.sql import functions as F
    return df.withColumns({n: F.lit("mine") for n in names})
