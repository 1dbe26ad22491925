"""Likeness of short strings: the ratio of their longest common subsequence, and its
form over sets of words. Arrow batches; used within blocks of candidates only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

EXACT, ALIKE, CONFLICT = 1, 2, 3
SIMILAR_COMPANY, DIFFERENT_COMPANY = 92, 80
SIMILAR_ROLE, DIFFERENT_ROLE = 90, 70


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met) | (row - met)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


@F.pandas_udf(DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _starts(a: Column, b: Column) -> Column:
    """One is the first words of the other."""
    return F.concat(a, F.lit(" ")).startswith(F.concat(b, F.lit(" "))) | F.concat(b, F.lit(" ")).startswith(F.concat(a, F.lit(" ")))


def company_relation(a: Column, b: Column) -> Column:
    """exact, similar, conflict or null, of normal forms."""
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    like = ratio_of(a, b)
    return F.when(known, F.when(a == b, "exact").when(_starts(a, b) | (like >= SIMILAR_COMPANY), "similar").when(like < DIFFERENT_COMPANY, "conflict"))


def role_relation(a: Column, b: Column) -> Column:
    known = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    like = token_set_of(a, b)
    return F.when(known, F.when(a == b, "exact").when(like >= SIMILAR_ROLE, "similar").when(like < DIFFERENT_ROLE, "conflict"))


def company_code(a: str, b: str) -> int:
    """EXACT, ALIKE, CONFLICT or 0 of two normal forms."""
    if not a or not b:
        return 0
    if a == b:
        return EXACT
    like = ratio(a, b)
    if f"{a} ".startswith(f"{b} ") or f"{b} ".startswith(f"{a} ") or like >= SIMILAR_COMPANY:
        return ALIKE
    return CONFLICT if like < DIFFERENT_COMPANY else 0


def role_code(a: str, b: str) -> int:
    if not a or not b:
        return 0
    like = 100.0 if a == b else token_set_ratio(a, b)
    return EXACT if a == b else ALIKE if like >= SIMILAR_ROLE else CONFLICT if like < DIFFERENT_ROLE else 0


def _codes(one: pa.Array, others: pa.Array, code: Callable[[str, str], int]) -> pa.Array:
    """The code of each name with each of a list; a pair of names is compared once a batch."""
    size = np.diff(others.offsets.to_numpy())
    names, flat = one.dictionary_encode(), others.flatten().dictionary_encode()
    left, right = (x.indices.fill_null(len(x.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, flat))
    a, b = [*names.dictionary.to_pylist(), ""], [*flat.dictionary.to_pylist(), ""]
    pairs, back = np.unique(np.repeat(left, size) * len(b) + right, return_inverse=True)
    found = np.array([code(a[p // len(b)], b[p % len(b)]) for p in pairs.tolist()], np.int32)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[back] if len(found) else found))


@F.arrow_udf(ArrayType(IntegerType()))
def company_relations(one: pa.Array, others: pa.Array) -> pa.Array:
    return _codes(one, others, company_code)


@F.arrow_udf(ArrayType(IntegerType()))
def role_relations(one: pa.Array, others: pa.Array) -> pa.Array:
    return _codes(one, others, role_code)
