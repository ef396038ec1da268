"""Vector scalars: literals, cosine similarity, the hybrid score."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearwell import constants as K


def vector_literal(v) -> Column:
    """array<float> as '[a,b,...]'."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","),
                    F.lit("]"))


def parse_vector(s) -> Column:
    """'[a,b,...]' as array<float>."""
    parts = F.split(F.regexp_replace(s, r"^\s*\[|\]\s*$", ""), ",")
    return F.transform(parts, lambda x: F.trim(x).cast("float"))


def dot(a, b) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a, b) -> Column:
    """1 - cosine distance, in double. Undefined (NULL) for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norms)


def hybrid_score(sim, dist, radius, beds, doctors) -> Column:
    """Similarity, nearness and capacity in one figure, rounded to 4 digits."""
    beds = F.coalesce(beds, F.lit(0)).cast("double")
    doctors = F.coalesce(doctors, F.lit(0)).cast("double")
    return F.round(
        K.WEIGHT_SIMILARITY * sim
        + K.WEIGHT_DISTANCE * (1 - dist / radius)
        + K.WEIGHT_BEDS * F.least(F.lit(1.0), beds / K.BEDS_SCALE)
        + K.WEIGHT_DOCTORS * F.least(F.lit(1.0), doctors / K.DOCTORS_SCALE), 4)
