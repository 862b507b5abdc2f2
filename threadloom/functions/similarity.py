"""Similarity scores of two conversations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REFERENCE_WEIGHT = 0.6
EMBEDDING_WEIGHT = 0.4
SAME_AUTHOR_OVERLAP = 0.7


def jaccard_from_sizes(shared: Column, left: Column, right: Column) -> Column:
    """Overlap from the sizes of two sets and of their intersection; 0 for two empty sets."""
    union = left + right - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    return jaccard_from_sizes(F.size(F.array_intersect(left, right)), F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double arithmetic: 0 for a zero vector, an error when sizes differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(_dot(a, b) / norm)
    mismatch = F.raise_error(F.concat(F.lit("Vector dimension mismatch: "), F.size(a).cast("string"), F.lit(" vs "), F.size(b).cast("string")))
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(F.size(a) != F.size(b), mismatch.cast("double")).otherwise(value))


def hybrid(reference: Column, a: Column, b: Column, reference_weight: float = REFERENCE_WEIGHT,
           embedding_weight: float = EMBEDDING_WEIGHT) -> Column:
    """Weighted sum of the reference score and the positive part of the cosine. Without both vectors the
    reference score counts alone and is not scaled."""
    vector = F.greatest(F.lit(0.0), cosine(a, b))
    return F.when(a.isNull() | b.isNull(), reference).otherwise(reference_weight * reference + embedding_weight * vector)


def same_author(shared: Column, left: Column, right: Column) -> Column:
    """Same author from participant counts: one person each and the same, or a participant overlap of at least 0.7.
    ``shared`` is the size of the intersection."""
    single = (left == 1) & (right == 1)
    union = left + right - shared
    return F.when(single, shared == 1).otherwise((union > 0) & (shared / F.greatest(union, F.lit(1)) >= SAME_AUTHOR_OVERLAP))
