"""Text as columns: clipping, tokens, keywords, sentences, numbers, titles. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import (
    CLIP_CHARS, CLIP_HEAD, CLIP_MIDDLE, CLIP_TAIL, FALLING, LSH_HEAD, LSH_MIDDLE, LSH_TAIL, LSH_TOKENS, MAINTENANCE_STOP, MAX_TOKENS, RISING, STOP_CHARACTERS,
)

BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
WORDS = r"[\p{L}\p{N}_]+"
CJK_ONLY = "^[一-鿿]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def clip(c: Column) -> Column:
    """Head, middle and tail of a text of more than CLIP_CHARS characters."""
    middle = F.floor((F.length(c) - CLIP_MIDDLE) / 2).cast("int") + 1
    cut = F.concat(F.substring(c, 1, CLIP_HEAD), F.lit("\n"), F.substring(c, middle, F.lit(CLIP_MIDDLE)), F.lit("\n"), F.right(c, F.lit(CLIP_TAIL)))
    return F.when(F.length(c) <= CLIP_CHARS, c).otherwise(cut)


def tokens(c: Column) -> Column:
    """Word runs of the clipped lower-case text; all-CJK runs split into characters; stop characters dropped; the first MAX_TOKENS."""
    words = F.regexp_extract_all(F.lower(clip(c)), F.lit(WORDS), 0)
    split = F.flatten(F.transform(words, lambda w: F.when(w.rlike(CJK_ONLY), F.split(w, "")).otherwise(F.array(w))))
    stop = F.array(*[F.lit(x) for x in STOP_CHARACTERS])
    return F.slice(F.filter(split, lambda t: (t != "") & ~F.array_contains(stop, t)), 1, MAX_TOKENS)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def bounded_tokens(t: Column) -> Column:
    """The tokens that a signature is taken of: head, middle and tail of more than LSH_TOKENS."""
    middle = F.floor((F.size(t) - LSH_MIDDLE) / 2).cast("int") + 1
    cut = F.concat(F.slice(t, 1, LSH_HEAD), F.slice(t, middle, LSH_MIDDLE), F.slice(t, F.lit(-LSH_TAIL), F.lit(LSH_TAIL)))
    return F.when(F.size(t) <= LSH_TOKENS, t).otherwise(cut)


def index_tokens(c: Column) -> Column:
    return F.slice(F.regexp_extract_all(F.lower(clip(c)), F.lit("[a-z0-9_]{2,}|[一-鿿]{2,6}"), 0), 1, MAX_TOKENS)


def maintenance_keywords(c: Column, k: int = 10) -> Column:
    """The first k keywords, repeats included."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{2,}|[一-鿿]{2,}"), 0)
    return F.slice(F.filter(found, lambda t: ~t.isin(MAINTENANCE_STOP)), 1, k)


def question_tokens(c: Column) -> Column:
    """All pairs of characters, and all characters, of the text with a blank for whatever is no letter, digit or underscore."""
    flat = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " ")
    characters = F.filter(F.split(flat, ""), lambda t: t != "")
    n = F.size(characters)
    # Two shifted copies are zipped, as an expression inside a lambda would be computed again for every element.
    later = F.slice(characters, F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(characters, F.lit(1), F.greatest(n - 1, F.lit(0))), later, lambda a, b: F.concat(a, b))
    return F.concat(pairs, characters)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays without repeats; `empty` is the value where either is empty (both, where it is 1)."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    none = (either == 0) if empty == 1.0 else ((F.size(a) == 0) | (F.size(b) == 0))
    return F.when(none, F.lit(empty)).otherwise(shared / either)


def occurrences(c: Column, word: str) -> Column:
    """How often a word occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word)))) / len(word)).cast("int")


def trend(c: Column) -> Column:
    up, down = (sum(occurrences(c, w) for w in words) for words in (RISING, FALLING))
    return F.when(up > down, "上升").when(down > up, "下降").otherwise("平稳")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"-?\d+\.?\d*%?"), 0)


def sentences(c: Column, marks: str = r"[。！？!?\n]+", longer_than: int = 5) -> Column:
    return F.filter(F.transform(F.split(c, marks), stripped), lambda s: F.length(s) > longer_than)


def scored_sentences(c: Column, whole: Column) -> Column:
    """(score, sentence), best first: mean frequency of the sentence's tokens among `whole`, and a bonus for standing early."""

    def scored(s: Column, i: Column) -> Column:
        own = tokens(s)
        total = F.aggregate(own, F.lit(0), lambda acc, t: acc + F.size(whole) - F.size(F.array_remove(whole, t)))
        return F.struct((total / F.greatest(F.size(own), F.lit(1)) + F.lit(0.5) / (i + 1)).alias("score"), s.alias("sentence"))

    return F.sort_array(F.transform(sentences(c), scored), asc=False)


def with_summary(df: DataFrame, text: str) -> DataFrame:
    """`df` with `summary`: the three best sentences, or the beginning of a text without sentences."""
    ranked = df.withColumn("_whole", tokens(F.col(text))).withColumn("_ranked", scored_sentences(F.col(text), F.col("_whole")))
    best = F.transform(F.slice("_ranked", 1, 3), lambda s: s["sentence"])
    joined = F.when(F.size("_ranked") > 0, F.concat(F.array_join(best, "。"), F.lit("。"))).otherwise(F.substring(text, 1, 200))
    return ranked.withColumn("summary", joined).drop("_whole", "_ranked")


def safe_filename(c: Column, most: int) -> Column:
    clean = F.regexp_replace(F.regexp_replace(c, r"[/\\:*?\"<>|\n\r\t]", "_"), "_+", "_")
    clean = F.regexp_replace(clean, "^[_ ]+|[_ ]+$", "")
    return F.substring(F.when(clean == "", "untitled").otherwise(clean), 1, most)


def title(c: Column) -> Column:
    """The first sentence without brackets, where its beginning is Chinese; else the longest Chinese run; else null."""
    first = stripped(F.element_at(F.split(c, "[。！？；\n]"), 1))
    clean = stripped(F.element_at(F.split(F.regexp_replace(first, "[（(][^）)]*[）)]", ""), "——"), 1))
    runs = F.regexp_extract_all(c, F.lit("[一-鿿]{2,}"), 0)
    longest = F.aggregate(runs, F.lit(""), lambda acc, r: F.when(F.length(r) > F.length(acc), r).otherwise(acc))
    chinese = F.substring(clean, 1, 10).rlike("[一-鿿]") & (F.length(clean) >= 2)
    return F.when(chinese, F.regexp_replace(F.substring(clean, 1, 35), "[，, ]+$", "")).when(F.size(runs) > 0, F.substring(longest, 1, 35))


def front_matter(c: Column) -> Column:
    """The fields of a text's front matter as a map; an empty one where there is none."""
    block = F.regexp_extract(c, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            stripped(F.substring_index(x, ":", 1)).alias("key"),
            F.regexp_replace(stripped(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("value"),
        ),
    )
    return F.map_from_entries(F.array_distinct(pairs))


def body(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?s)^---\s*\n.*?\n---\s*\n?", ""))
