"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepwright.llm.common import ascii_lower, join_few, join_rows, release, stored, text_key
from prepwright.session import is_broadcastable

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
WINDOW = 10          # words; a shared run of this length is always found
GRAM = 5             # words of a fingerprint
CHUNK = 64           # window starts that are looked at together


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a missing text has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(1)), F.array().cast("array<string>"))


def _array(of: str, at: str, n: int) -> str:
    return ", ".join(f"{of}[{at} + {j}]" for j in range(n))


def fingerprints(df: DataFrame, keys: list[str], spans: list[int], gram: int) -> DataFrame:
    """Winnowing: keys, span, at, fingerprint for texts with the column ``words``, and their number of words.

    Each word is hashed once, and ``gram`` neighbouring word hashes once more. Of each ``span - gram + 1`` consecutive
    hashes the smallest is kept: a window of ``span`` words holds just that many, so two equal windows keep
    an equal one. ``at`` is the first of CHUNK window starts that are looked at together. A row with span 0
    comes for every text, whatever it holds; its ``at`` is the number of words.
    """
    df = df.selectExpr(*keys, "size(words) as n_words", "transform(words, w -> xxhash64(w)) as hashes")
    found = []
    for span in spans:
        size, width = min(gram, span), span - min(gram, span) + 1
        df = df.selectExpr("*", f"""if(n_words < {span}, array(), transform(sequence(0, n_words - {size}),
            i -> xxhash64({_array("hashes", "i", size)}))) as grams_{span}""")
        if width > 1:
            df = df.selectExpr("*", f"""if(n_words < {span}, array(), transform(sequence(0, n_words - {span}),
                i -> least({_array(f"grams_{span}", "i", width)}))) as least_{span}""")
        kept = f"least_{span}" if width > 1 else f"grams_{span}"
        found.append(f"""if(n_words < {span}, array(), flatten(transform(sequence(0, n_words - {span}, {CHUNK}),
            a -> transform(array_distinct(slice({kept}, a + 1, {CHUNK})), f -> named_struct('span', {span}, 'at', a, 'fingerprint', f)))))""")
    rows = ", ".join(["array(named_struct('span', 0, 'at', n_words, 'fingerprint', 0L))", *found])
    return df.selectExpr(*keys, f"inline(concat({rows}))")


def _windows(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """All windows of ``span`` words of each ``piece``, which begins at word ``at``, as text."""
    return pieces.selectExpr(*keys, "span", """inline(transform(sequence(0, size(piece) - span),
        i -> named_struct('start', at + i, 'window', array_join(slice(piece, i + 1, span), ' '))))""")


def _numbered_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(number, span, window) of the distinct item windows, and (number, item_id)."""
    pieces = items.filter("size(words) > 0").selectExpr("item_id", f"least(size(words), {window}) as span", "0 as at", "words as piece")
    held = stored(_windows(pieces, ["item_id"]).select("item_id", "span", "window").distinct(), "item-windows")
    numbers = stored(held.select("span", "window").distinct().withColumn("number", F.monotonically_increasing_id()), "window-numbers")
    named = stored(held.join(numbers, ["span", "window"]).select("number", "item_id"), "window-items")
    release(held)
    return numbers, named


def looked_up(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The fingerprint rows that the stored table ``listed`` (span, fingerprint) holds; a long table is not broadcast."""
    keys = ["span", "fingerprint"]
    if is_broadcastable(listed):
        return rows.join(F.broadcast(listed), keys, "left_semi")
    return join_few(rows, listed, "inner", tuple(keys))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items (ids as sorted strings), contaminated.

    Fingerprints of documents and items are joined; each document chunk that shares one is looked at
    again, and the hit is extended to every window of the chunk that equals an item's window word for
    word. An item of fewer words than ``window``, but not none, is one window of its own length.

    A document word inside any occurrence of an item window is hit. A missing or empty text has no words,
    an item without words no window, an item without an id is found but not named. Rows that repeat a
    document give a row each, and repeated items count once. An empty table on either side gives no hits.
    Other columns are not looked at.
    """
    keys = ["doc_id", "text_hash"]
    items = items.select("item_id", words(F.col("text")).alias("words"))
    # Which lengths windows have: at most ``window`` rows.
    spans = sorted(r[0] for r in items.filter("size(words) > 0").select(F.least(F.size("words"), F.lit(window))).distinct().collect())
    texts = docs.select(*text_key(), "text")
    numbers, named = _numbered_windows(items, window)
    # A text's row with its number of words is always wanted.
    listed = stored(fingerprints(items.withColumn("span_of", F.least(F.size("words"), F.lit(window))), ["span_of"], spans, gram)
                    .filter("span in (0, span_of)").selectExpr("span", "fingerprint").distinct()
                    .union(docs.sparkSession.sql("select 0, 0L")).distinct(), "item-fingerprints")
    read = texts.select(*keys, words(F.col("text")).alias("words"))
    hits = looked_up(fingerprints(read, keys, spans, gram), listed).groupBy(*keys).agg(
        F.max(F.when(F.col("span") == 0, F.col("at"))).cast("bigint").alias("n_words"), F.count_if(F.col("span") == 0).alias("rows"),
        F.collect_set(F.when(F.col("span") > 0, F.struct("span", "at"))).alias("ats"))
    hits = stored(hits, "contamination-hits")

    near = hits.filter("size(ats) > 0").select(*keys, "ats")
    pieces = (join_few(texts, near, "inner").select(*keys, "ats", words(F.col("text")).alias("words"))
              .selectExpr(*keys, f"inline(transform(ats, a -> named_struct('span', a.span, 'at', a.at, 'piece', slice(words, a.at + 1, {CHUNK - 1} + a.span))))"))
    found = stored(_windows(pieces, keys).join(numbers, ["span", "window"]).select(*keys, "start", "span", "number").distinct(), "contamination")

    # Overlapping occurrences: each adds the words past the furthest end before it.
    ends = found.groupBy(*keys, "start").agg(F.max(F.col("start") + F.col("span")).alias("end"))
    ends = ends.selectExpr("*", "coalesce(max(`end`) over (partition by doc_id, text_hash order by start "
                                "rows between unbounded preceding and 1 preceding), 0) as reached")
    hit = ends.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("n_hit"))
    held = found.select(*keys, "number").distinct().join(named, "number").groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = join_rows(join_rows(hits.select(*keys, "n_words", "rows"), hit, "left"), held, "left")
    return rows.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.expr("explode(sequence(1L, rows))").alias("_row")).drop("_row")
