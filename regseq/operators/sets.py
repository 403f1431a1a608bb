"""Set operations on ids, intervals, sequences and motifs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.dropDuplicates([key])


def intersect_ids(reference: DataFrame, subject: DataFrame, key: str = "id") -> DataFrame:
    """The subject's rows that the reference has; the subject's repeats stay."""
    return subject.join(reference.select(key).distinct(), key, "left_semi")


def ids_overlap(a: DataFrame, b: DataFrame, key: str = "id") -> bool:
    return not a.join(b.select(key), key, "left_semi").isEmpty()


def overlap_row(a: DataFrame, b: DataFrame, name: str = "overlap", key: str = "id") -> DataFrame:
    """One row that says whether the two share an id, in the caller's plan: nothing runs before it is asked for."""
    shared = a.join(b.select(key), key, "left_semi").limit(1)
    return shared.agg((F.count("*") > 0).alias(name))


def subset_by_flag(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(flag).drop(flag)


def union_sets(*sets: DataFrame) -> DataFrame:
    """Repeats stay."""
    return reduce(DataFrame.unionByName, sets)


def union_sequences(*sets: DataFrame) -> DataFrame:
    """Records equal in all columns once."""
    return union_sets(*sets).dropDuplicates()


def union_motifs(*sets: DataFrame) -> DataFrame:
    """One motif of each accession."""
    return union_sets(*sets).dropDuplicates(["accession"])
