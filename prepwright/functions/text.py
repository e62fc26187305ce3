"""Text expressions, evaluated on the JVM side but for character references."""

from __future__ import annotations

import html
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Unicode-aware classes for "not a word character or blank" and edge blanks.
EDGE_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}]"

# Where text breaks into lines.
LINE_BREAK = r"\R|[\x1c-\x1e]"


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Named and numeric character references as characters; texts without ``&`` stay on the JVM side."""
    return F.when(F.contains(c, F.lit("&")), _unescaped(c)).otherwise(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_BLANKS, "")


def standardize(c: Column) -> Column:
    """Strip, lower-case and delete punctuation; NULL stays NULL."""
    return F.regexp_replace(F.lower(strip(c)), PUNCTUATION, "")


def html_to_text(c: Column) -> Column:
    """Visible text of an HTML page, one stripped non-blank line per row of text."""
    bare = F.regexp_replace(c, r"(?is)<script.*?>.*?</script>", "")
    bare = F.regexp_replace(bare, r"(?is)<style.*?>.*?</style>", "")
    bare = F.regexp_replace(bare, r"(?s)<.*?>", "")
    lines = F.transform(F.split(unescape(bare), LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def sorted_tokens(c: Column) -> Column:
    """Whitespace tokens in sorted order, re-joined by one blank."""
    tokens = F.filter(F.split(strip(c), r"\s+"), lambda token: token != "")
    return F.array_join(F.array_sort(tokens), " ")


def normal_form(c: Column) -> Column:
    """Upper case with underscores and hyphens read as blanks."""
    return F.replace(F.replace(F.upper(c), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
