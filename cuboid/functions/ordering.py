"""Order-preserving keys: those of floats Arrow-batched, as Spark can't see a float's bits; natural order as expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegerType

_RUN = re.compile(r"[0-9]+")


def _flip(bits: np.ndarray) -> np.ndarray:
    """Negative numbers run the other way; the same step turns it back."""
    return bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))


@F.pandas_udf(IntegerType())
def float_to_sortable(x: pd.Series) -> pd.Series:
    """An int that sorts as the float does; -0.0 comes before 0.0.  Null stays null."""
    out = pd.Series(_flip(x.to_numpy(np.float32).view(np.int32)), dtype="Int32")
    return out.mask(x.isna().to_numpy())


@F.pandas_udf(FloatType())
def sortable_to_float(x: pd.Series) -> pd.Series:
    present = x.notna().to_numpy()
    out = _flip(x.fillna(0).to_numpy(np.int32)).view(np.float32).astype(object)
    out[~present] = None
    return pd.Series(out)


def natural_text(s: str, ignore_case: bool = False) -> str:
    """A text whose plain order is the natural order of ``s``: spaces don't count, digit runs sort as numbers, those with a leading zero digit by digit and first."""
    s = "".join(s.split())
    if ignore_case:
        s = s.lower()

    def run(m: re.Match) -> str:
        digits = m[0]
        # The number's length goes first; it fits one character, so its order is that of the numbers.
        return "0\x00" + digits if digits[0] == "0" else "0\x01" + chr(len(digits) + 1) + digits

    return _RUN.sub(run, s)


def natural_key(x: Column | str, ignore_case: bool = False) -> Column:
    """``natural_text`` as an expression; the length of a digit run is written in ten digits.  Null stays null."""
    text = F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"\s+", "")
    runs = F.regexp_extract_all(F.lower(text) if ignore_case else text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    zero, number = F.lit("0\x00"), F.lit("0\x01")
    keyed = lambda r: F.when(r.startswith("0"), F.concat(zero, r)).when(r.rlike("^[0-9]"), F.concat(number, F.lpad(F.length(r).cast("string"), 10, "0"), r)).otherwise(r)
    return F.array_join(F.transform(runs, keyed), "")


def natural_key_nocase(x: Column | str) -> Column:
    return natural_key(x, True)


def sortable_less(a: Column, b: Column) -> Column:
    """Whether the float of one sortable int comes before that of another."""
    return a < b


def sortable_less_equal(a: Column, b: Column) -> Column:
    return a <= b
