"""Text helpers the operators of this subpackage share."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds of dash, apostrophe, zero-width characters and blanks.
DASHES = "-‐‑‒–—―−­﹘﹣－"
APOSTROPHES = "'‘’‚‛ʼʹ′`´＇"
ZERO_WIDTH = "​‌‍⁠﻿᠎"
BLANKS = r"\s\u0085   -     　"


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()))


def nfc_lower(c: Column) -> Column:
    """Lower case in composed form; only strings with characters beyond ASCII go to Python."""
    wide = c.rlike(r"[^\x00-\x7F]")
    in_python = F.pandas_udf(_nfc, StringType())(F.when(wide, c))
    return F.when(wide, in_python).otherwise(F.lower(c))


def one_form(c: Column) -> Column:
    """One spelling for strings that differ in case, composition, dashes, apostrophes, blanks or zero-width characters."""
    s = F.regexp_replace(c, f"[{ZERO_WIDTH}]", "")
    s = F.regexp_replace(s, f"[{APOSTROPHES}]", "'")
    s = F.regexp_replace(s, f"[{DASHES[1:]}]", "-")
    s = F.trim(F.regexp_replace(s, f"[{BLANKS}]+", " "))
    return nfc_lower(s)
