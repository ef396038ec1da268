"""Trigram similarity with the semantics of PostgreSQL's pg_trgm."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(c) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two blanks before, one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def grams(word):
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1),
                           lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def plain_words(c) -> Column:
    """The lower-cased words that trigrams are made of, parted by one blank."""
    return F.array_join(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")


def gram_codes(c) -> Column:
    """The trigrams of ``c`` as numbers (three code points of 21 bits), for cheap set operations.

    One code per gram and one gram per code, so similarities are those of the grams themselves.
    """
    def code(gram):
        point = [F.ascii(gram if i == 1 else F.substring(gram, i, 1)).cast("bigint")
                 for i in (1, 2, 3)]
        return F.shiftleft(point[0], 42) + F.shiftleft(point[1], 21) + point[2]

    return F.transform(trigrams(c), code)


def gram_similarity(a, b) -> Column:
    """Jaccard similarity of two gram arrays as a 4-byte float; NULL in, NULL out."""
    return shared_similarity(F.array_size(F.array_intersect(a, b)), F.array_size(a) + F.array_size(b))


def shared_similarity(shared, both) -> Column:
    """The same from the number of shared grams and the sum of the two numbers of grams."""
    union = both - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(
        F.try_divide(shared.cast("double"), union.cast("double"))).cast("float")


def trigram_similarity(a, b) -> Column:
    return gram_similarity(trigrams(a), trigrams(b))
