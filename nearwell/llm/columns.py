"""Column expressions shared by the operators of this subpackage."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, WORD_BREAK)).otherwise(
        F.array().cast("array<string>"))


def window_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of every run of ``n`` consecutive words; empty for shorter arrays.

    ``words`` must be a column of the input or bound by ``bind``, as it is read for every word.
    """
    count = F.size(words) - (n - 1)
    head = F.slice(words, 1, F.greatest(count, F.lit(0)))
    return F.transform(head, lambda w, i: F.xxhash64(w, *(F.get(words, i + k)
                                                          for k in range(1, n))))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is never substituted back.

    Catalyst copies an expression into every place that reads it when it merges projections or
    pushes a filter down; inside a lambda over array elements that would mean once per element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
