"""The few functions that need Python; each works on Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING_SIZE = 96
_token = re.compile(r"[a-z0-9_]{2,}")


def match_form(value: str | None) -> str | None:
    """Compatibility form, case folded, with punctuation, symbols and white space as single spaces."""
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join("".join(" " if c.isspace() or unicodedata.category(c)[0] in "PS" else c for c in folded).split())


def bag_vector(value: str | None, size: int = EMBEDDING_SIZE) -> list[float]:
    """Counts of hashed words at length 1; zeros for a text without words."""
    v = np.zeros(size)
    for token in _token.findall((value or "").lower()):
        v[int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "big") % size] += 1
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).tolist()


@F.pandas_udf(T.StringType())
def match_form_udf(values: pd.Series) -> pd.Series:
    return values.map(match_form)


@F.pandas_udf(T.ArrayType(T.StringType()))
def match_forms_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [match_form(x) for x in xs])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def bag_vector_udf(values: pd.Series) -> pd.Series:
    return values.map(bag_vector)


def review_id(site: str, slug: str, url: str, rating: float, body: str) -> str:
    """The id of a review that has none of its own: a hash of where it stands and what it says, white space and case of
    the text and address aside."""
    said = {"site": site, "slug": slug, "url": url.strip().lower(), "rating": round(rating, 2), "text": " ".join(body.lower().split())}
    return f"review:{site}:{slug}:{sha256(json.dumps(said, sort_keys=True, ensure_ascii=True).encode()).hexdigest()[:16]}"


@F.pandas_udf(T.StringType())
def review_id_udf(site: pd.Series, slug: pd.Series, url: pd.Series, rating: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(r) else review_id(a or "", b or "", c or "", float(r), d or "") for a, b, c, r, d in zip(site, slug, url, rating, body)], dtype=object)
