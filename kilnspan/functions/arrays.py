"""Array and tensor functions: JVM expressions, and three Arrow functions where Spark has none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Storage types by their names; bfloat16 is widened (fixed values).
DTYPES = {
    "bool": "?", "uint8": "u1", "int8": "i1", "int16": "<i2", "int32": "<i4", "int64": "<i8",
    "float16": "<f2", "bfloat16": "<u2", "float32": "<f4", "float64": "<f8",
    "short": "<i2", "int": "<i4", "long": "<i8", "half": "<f2", "float": "<f4", "double": "<f8",
}
SEPARATOR_BASE = 1_000_000
_DOUBLES = T.ArrayType(T.DoubleType())


def decode_bytes(dtype: str, shape, raw: bytes) -> np.ndarray:
    """The flat float64 values of one stored tensor; the element count must match the shape."""
    name = dtype.removeprefix("torch.")
    if name not in DTYPES:
        raise ValueError(f"unsupported dtype {dtype!r}")
    values = np.frombuffer(raw, dtype=DTYPES[name])
    if values.size != int(np.prod(list(shape), dtype=np.int64)):
        raise ValueError(f"{values.size} elements for shape {list(shape)}")
    if name == "bfloat16":
        values = (values.astype(np.uint32) << 16).view(np.float32)
    return values.astype(np.float64)


@F.pandas_udf(_DOUBLES)
def decode_tensor(dtype: pd.Series, shape: pd.Series, raw: pd.Series) -> pd.Series:
    """Flat values of stored tensors (bool as 0 and 1; int64 beyond 2^53 is rounded)."""
    return pd.Series([None if b is None else decode_bytes(d, s, b) for d, s, b in zip(dtype, shape, raw, strict=True)])


def levenshtein(a, b) -> int:
    """Unit-cost edit distance of two integer sequences; one row of the table at a time, vectorised."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if not len(b):
        return len(a)
    right, steps = np.asarray(b), np.arange(len(b) + 1)
    row = steps.copy()
    for n, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = n
        np.minimum(row[1:] + 1, row[:-1] + (right != x), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # insertions, left to right
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def token_levenshtein(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of two array columns of integers; null if either is null."""
    return pd.Series([None if a is None or b is None else levenshtein(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


def token_word(tokens: Column) -> Column:
    """A token sequence as a string of as many characters, equal for equal sequences.

    Tokens below 55,000 and layer separators have a code point of their own, outside the
    surrogates; any other token is an error.
    """
    plain, separator = lambda t: t.between(0, 54_999), lambda t: t.between(SEPARATOR_BASE, SEPARATOR_BASE + 6_000)
    code = lambda t: F.when(plain(t), t + 1).when(separator(t), t - SEPARATOR_BASE + 0xE000).otherwise(F.raise_error("token out of range").cast("int"))
    return F.decode(F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(code(t)), 4, "0")), "")), "UTF-16BE")


def project(weights_column: str = "weights", probs_column: str = "probs"):
    """Arrow function (probs of shape E, weights flat E x H) -> their product of length H."""

    @F.pandas_udf(_DOUBLES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for probs, weights in batches:
            yield pd.Series([None if p is None or w is None else np.asarray(p, dtype=np.float64) @ np.asarray(w, dtype=np.float64).reshape(len(p), -1) for p, w in zip(probs, weights, strict=True)])

    return run(F.col(probs_column), F.col(weights_column))


# ---------------------------------------------------------------- JVM expressions


def array_sum(a: Column) -> Column:
    """Sum of an array, in double."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """L2 norm."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, strict: bool = True) -> Column:
    """Cosine similarity; a zero norm is an error, or null if not strict."""
    bad = F.raise_error("zero norm").cast("double") if strict else F.lit(None).cast("double")
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, bad).otherwise(dot(a, b) / lengths)


def softmax(logits: Column) -> Column:
    """Softmax, shifted by the maximum."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    return F.transform(e, lambda x: x / array_sum(e))


def sigmoid_shares(logits: Column) -> Column:
    """Sigmoids over their sum, the sum at least 1e-20."""
    s = F.transform(logits, lambda x: 1.0 / (1.0 + F.exp(-x.cast("double"))))
    return F.transform(s, lambda x: x / F.greatest(array_sum(s), F.lit(1e-20)))


def entropy(probs: Column) -> Column:
    """Shannon entropy in nats, each probability at least 1e-20."""
    return -array_sum(F.transform(probs, lambda p: F.greatest(p.cast("double"), F.lit(1e-20)) * F.ln(F.greatest(p.cast("double"), F.lit(1e-20)))))


def top_k(values: Column, k: int) -> tuple[Column, Column]:
    """The k largest values in descending order, and their int positions; ties by position."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    best = F.slice(F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))), 1, k)
    return F.transform(best, lambda s: -s["n"]), F.transform(best, lambda s: s["i"])


def pathway_tokens(probs: Column, threshold: float) -> Column:
    """The fewest experts, most probable first, whose probabilities reach the threshold; ties by expert id.

    Sums run in the array's own type (float stays float).
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("pathway threshold must be in (0, 1]")
    order = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    limit = F.lit(threshold).cast("float")
    start = F.struct(F.lit(0).cast("float").alias("c"), F.lit(0).alias("k"))
    walk = F.aggregate(order, start, lambda a, e: F.struct((a["c"] - e["n"].cast("float")).cast("float").alias("c"), F.when((a["c"] - e["n"].cast("float")).cast("float") < limit, a["k"] + 1).otherwise(a["k"]).alias("k")))
    count = F.greatest(F.lit(1), F.least(walk["k"] + 1, F.size(probs)))
    return F.transform(F.slice(order, F.lit(1), count), lambda s: s["i"])


def pathway_sequence(layers: Column) -> Column:
    """Layers' tokens in one sequence, with a separator before every layer but the first."""
    return F.flatten(F.transform(layers, lambda t, i: F.when(i > 0, F.concat(F.array(F.lit(SEPARATOR_BASE) + i), t)).otherwise(t)))


def consistency(vectors: Column, eps: float) -> Column:
    """1 - mean over neighbouring layers of cos / (largest cos + eps)."""
    pairs = F.sequence(F.lit(1), F.size(vectors) - 1)
    cos = F.transform(pairs, lambda i: cosine(F.element_at(vectors, i), F.element_at(vectors, i + 1)))
    shares = F.transform(cos, lambda c: c / (F.array_max(cos) + eps))
    return F.when(F.size(vectors) > 1, 1.0 - array_sum(shares) / F.size(cos))


def normalize_weights(weights: Column, strict: bool = True) -> Column:
    """Positive finite weights over their sum; anything else is an error, or null if not strict."""
    total = array_sum(weights)
    good = (F.size(weights) > 0) & F.forall(weights, lambda w: F.coalesce((w > 0) & (w < float("inf")) & ~F.isnan(w), F.lit(False)))
    bad = F.raise_error("weights must be nonempty, finite and positive").cast("array<double>") if strict else F.lit(None).cast("array<double>")
    return F.when(F.coalesce(good, F.lit(False)), F.transform(weights, lambda w: w.cast("double") / total)).otherwise(bad)


def updated_mixture(weights: Column, indicators: Column, eta: Column, smoothing: Column) -> Column:
    """softmax(ln w + eta indicator), mixed with the uniform mixture."""
    logits = F.zip_with(weights, indicators, lambda w, i: F.ln(w) + eta * i)
    return F.transform(softmax(logits), lambda a: (1.0 - smoothing) * a + smoothing / F.size(weights))

