"""Character n-grams as column expressions; characters are Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ngrams(text: Column | str, n: int) -> Column:
    """All n-grams in order; an empty array where n is 0 or the text is shorter."""
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    if n <= 0:
        return F.when(text.isNotNull(), none)
    # Characters are cut apart once: a substring would count from the beginning of the text every time.
    chars = F.split(text, "")
    starts = F.sequence(F.lit(0), F.length(text) - n)  # would count down where the text is shorter
    if n <= 16:
        gram = lambda c, i: F.concat(*(F.get(c, i + k) for k in range(n)))
    else:
        gram = lambda c, i: F.array_join(F.slice(c, i + 1, n), "")
    # The characters are bound by a lambda of their own, so they aren't cut apart again for every n-gram.
    grams = F.flatten(F.transform(F.array(chars), lambda c: F.transform(starts, lambda i: gram(c, i))))
    return F.when(text.isNull(), None).when(F.length(text) >= n, grams).otherwise(none)


def ngram_set(text: Column | str, n: int) -> Column:
    return F.array_distinct(char_ngrams(text, n))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: 1 where both are empty, 0 where one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))


def jaccard_similarity(a: Column | str, b: Column | str, n: int) -> Column:
    return jaccard_of_sets(ngram_set(a, n), ngram_set(b, n))
