"""The canonical key of a text: equal for copies that differ only in formatting.

Prose is reduced to its letters and digits in lower case. A record (three or more fields and nothing else, as
`name: value` lines, `name=value;` lists, table rows, front matter or a JSON object) is reduced to its sorted name/value
pairs. All of it is a native column expression.

A JSON text counts as a record only if its pairs, blanks and commas are all that its braces hold. A list or an object
inside it is one value, in the order given; one with further brackets inside makes the whole text prose, keyed by all of
its letters.

Defined results: a null text has a null key; a text without letters or digits is keyed by its exact characters, so
that only identical ones are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"[\p{L}_][\p{L}\p{N}_]{0,23}(?: [\p{L}\p{N}_]{1,16})?"
# Possessive, so that long values need no stack.
_STRING = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
_INNER = rf'[^\[\]{{}}"]*+(?:{_STRING}[^\[\]{{}}"]*+)*+'
JSON_PAIR = rf'{_STRING}\s*+:\s*+(?:{_STRING}|\[{_INNER}\]|\{{{_INNER}\}}|[^,{{}}\[\]\s"]++)'
JSON_TEXT = rf"^\{{[\s,]*+(?:{JSON_PAIR}[\s,]*+)++\}}$"
JSON_ESCAPE = r"\\[\\bfnrt]"
FENCE = r"(?m)^[\s\p{Z}]*-{3,}[\s\p{Z}]*$"
FIELD = rf"^[\s\p{{Z}}]*[|\"]?[\s\p{{Z}}]*({NAME})[\s\p{{Z}}\"]*[|:：=][\s\p{{Z}}]*(.*?)[\s\p{{Z}}|,]*$"
ROW = rf"(?m)^[\s\p{{Z}}]*\|[\s\p{{Z}}]*{NAME}[\s\p{{Z}}]*\|[^\n|]*\|[\s\p{{Z}}]*$"
MIN_FIELDS = 3


def letters(c: Column) -> Column:
    """Lower-case letters and digits only; sharp s counts as ss, as it does in upper case."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), "ß", "ss")


def fields(c: Column) -> Column:
    """The parts of a text that may be fields."""
    body = F.trim(F.regexp_replace(F.regexp_replace(c, FENCE, ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    pairs = F.regexp_extract_all(body, F.lit(JSON_PAIR), F.lit(0))
    parts = (
        F.when(body.startswith("{") & body.rlike(JSON_TEXT), F.transform(pairs, lambda p: F.regexp_replace(p, JSON_ESCAPE, " ")))
        .when(body.contains("\n"), F.split(body, r"\s*\n\s*"))
        .otherwise(F.split(body, r"\s*[;；]\s*"))
    )
    return F.filter(parts, lambda p: F.trim(p) != "")


def canonical_text(c: Column) -> Column:
    parts = fields(c)
    pairs = F.transform(
        parts, lambda p: F.concat(letters(F.regexp_extract(p, FIELD, 1)), F.lit("\x1f"), letters(F.regexp_extract(p, FIELD, 2)))
    )
    # The cheap test first: few texts look like records at all.
    looks = c.rlike(r"^[\s\p{Z}]*(?:[{|]|-{3}|[\p{L}_][\p{L}\p{N}_ ]{0,40}[\s\p{Z}]*[:：=])")
    record = looks & (F.size(parts) >= MIN_FIELDS) & F.forall(parts, lambda p: p.rlike(FIELD))
    plain = letters(c)
    return F.when(record, F.concat(F.lit("R"), F.array_join(F.array_sort(pairs), "\x1e"))).otherwise(
        F.when(plain == "", F.concat(F.lit("X"), c)).otherwise(F.concat(F.lit("P"), plain))
    )


def with_copy_key(df: DataFrame, text: str) -> DataFrame:
    """`df` with k1 and k2, two 64-bit hashes of the canonical text: 128 bits, so that no two texts meet by chance."""
    keyed = df.withColumn("_canonical", F.when(F.col(text).isNotNull(), canonical_text(F.col(text))))
    # Both hashes read one column, which Catalyst leaves in a projection of its own, so that it is computed once.
    return keyed.withColumns(
        {f"k{i}": F.when(F.col("_canonical").isNotNull(), F.xxhash64(F.lit(i), "_canonical")) for i in (1, 2)}
    ).drop("_canonical")
