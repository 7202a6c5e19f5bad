"""Text functions: fields to one text, normalisation, affixes, character n-grams, and tokens back to text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def as_list(on: str | list[str] | tuple[str, ...]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def content(on: str | list[str]) -> Column:
    """The fields joined by a blank each; a null field is empty but keeps its blank."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in as_list(on)])


def unaccented() -> tuple[str, str]:
    """Letters that are a plain letter with marks, and those plain letters, by Unicode's own decompositions."""
    pairs = [(c, base) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(base := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and base != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def normalize(text: Column, strip_punctuation: bool = False, strip_accents: bool = False) -> Column:
    """Lower case, blanks squeezed to one; ``strip_accents`` takes marks off Latin letters, composed or not."""
    out = F.lower(text)
    if strip_accents:
        out = F.regexp_replace(F.translate(out, *unaccented()), r"\p{M}", "")
    if strip_punctuation:
        out = F.translate(out, PUNCTUATION, " " * len(PUNCTUATION))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_words(text: Column, stop_words: tuple[str, ...]) -> Column:
    """A normalised text without these words."""
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(*stop_words)), " ") if stop_words else text


def grams(text: Column, low: int, high: int) -> Column:
    """All substrings of low..high letters, each as often as it occurs. Look-ahead: substr would walk each text from its start."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)])


def n_grams(text: Column, low: int, high: int) -> Column:
    """How many ``grams`` a text has, without making them."""
    return sum((F.greatest(F.lit(0), F.length(text) - n + 1) for n in range(low, high + 1)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def gram_counts(docs: DataFrame, key: str | list[str], text: Column, analyzer: str = "char_wb", ngram_range: tuple[int, int] = (3, 5)) -> DataFrame:
    """key, term, tf. ``char``: n-grams of the whole text; ``char_wb``: inside each word, each distinct word of a text taken once; ``word``: words."""
    low, high = ngram_range
    keys = as_list(key)
    if analyzer == "char":
        return docs.select(*keys, F.explode(grams(text, low, high)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    if analyzer not in ("char_wb", "word"):
        raise ValueError(f"unknown analyzer {analyzer!r}")
    each = docs.select(*keys, F.explode(words(text)).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    if analyzer == "word":
        return each.select(*keys, F.col("word").alias("term"), F.col("n").alias("tf"))
    return each.select(*keys, "n", F.explode(grams(F.col("word"), low, high)).alias("term")).groupBy(*keys, "term").agg(F.sum("n").alias("tf"))


def with_prefix(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def with_masks(text: Column, mask: str, n: int) -> Column:
    return F.concat(text, F.lit(" " + " ".join([mask] * n))) if n else text


def decode(activations: DataFrame, vocabulary: DataFrame, key: str, k: int = 96) -> DataFrame:
    """key, text: the k strongest positive terms of each key as words, best first, without punctuation."""
    order = Window.partitionBy(key).orderBy(F.desc("value"), "term")
    best = activations.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).where("value > 0").join(vocabulary, "term")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    bare = F.translate(joined, PUNCTUATION, "")
    return best.groupBy(key).agg(F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))
