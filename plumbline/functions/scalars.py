"""Scalar functions on columns: seeds, masking, doses, simplex arithmetic."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED_BOUND = 2**31 - 1


def stable_seed(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by ||, modulo 2^31 - 1; null parts count as empty."""
    joined = F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    number = F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(SEED_BOUND).cast("decimal(20,0)")).cast("long")


def stable_seed_of(*parts: object) -> int:
    """stable_seed for values on the driver."""
    return int(hashlib.sha256("||".join(map(str, parts)).encode()).hexdigest()[:16], 16) % SEED_BOUND


def format_dose(theta: Column) -> Column:
    return F.format_string("%.6f", theta)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def on_simplex(w: Column) -> Column:
    """Weights clipped at 0 and brought to sum 1; equal ones where nothing is left."""
    kept = F.transform(w, lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.transform(kept, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(w)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column, k: int = 1) -> Column:
    """The k-th probability; the greatest logit is taken off first."""
    top = F.array_max(logits)
    return F.exp(F.get(logits, F.lit(k)) - top) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def file_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != "")


def mask_text(text: Column, theta: Column, seed: Column, mask: str = "[MASK]") -> Column:
    """The text with round(theta * tokens) of its tokens (halves to even) masked, tokens joined by one space.

    Which ones is drawn by digests of seed and place. Nothing to mask, or no tokens: the text as it is. Null text: null.
    """
    t = tokens(text)
    n = F.size(t)
    k = F.least(F.bround(theta * n, 0).cast("int"), n)
    drawn = F.transform(t, lambda x, i: F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string"))))
    limit = F.element_at(F.array_sort(drawn), F.greatest(k, F.lit(1)))
    masked = F.zip_with(t, drawn, lambda x, d: F.when(d <= limit, F.lit(mask)).otherwise(x))
    return F.when((n > 0) & (k > 0), F.array_join(masked, " ")).otherwise(text)


def shuffled_mask(text: str | None, theta: float, seed: int, mask: str = "[MASK]") -> str | None:
    """As mask_text for one text, with the places drawn by a seeded Mersenne twister."""
    words = (text or "").split()
    k = int(round(theta * len(words)))
    if k <= 0 or not words:
        return text
    places = list(range(len(words)))
    random.Random(seed).shuffle(places)
    gone = set(places[: min(k, len(words))])
    return " ".join(mask if i in gone else w for i, w in enumerate(words))


@F.pandas_udf(T.StringType())
def mask_text_shuffled(text: pd.Series, theta: pd.Series, seed: pd.Series) -> pd.Series:
    """shuffled_mask in Arrow batches, where the draw must be the twister's."""
    return pd.Series([shuffled_mask(t, th, int(s)) for t, th, s in zip(text, theta, seed)], dtype=object)
