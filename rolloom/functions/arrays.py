"""Functions over token arrays, one row per response. Masks are arrays of 0 and 1 of the same length."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an array's definition inside a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum where the mask is not 0; NaN elsewhere does not matter."""
    return F.aggregate(F.zip_with(values, mask, lambda x, m: F.when(m != 0, x * m).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def mask_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (mask_count(mask) + 1e-8)


def masked_var(values: Column, mask: Column) -> Column:
    """Unbiased variance; an error where the mask holds fewer than two places."""
    n = mask_count(mask)
    squares = let(masked_sum(values, mask) / n, lambda mean: masked_sum(F.transform(values, lambda x: (x - mean) * (x - mean)), mask))
    return F.when(n > 1, squares / (n - 1)).otherwise(F.raise_error(F.lit("the variance needs two unmasked places")))


def response_mask(ids: Column, eos: list[int]) -> Column:
    """Ones through the first end token, itself included."""
    first = F.coalesce(F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(x.isin(eos), i)), lambda i: i.isNotNull())), F.size(ids))
    return let(first, lambda p: F.transform(ids, lambda x, i: F.when(i <= p, 1).otherwise(0)))


def pad_right(values: Column, length: int, fill) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(values), F.lit(0)))), 1, length)


def pad_left(values: Column, length: int, fill) -> Column:
    cut = F.slice(values, F.greatest(F.size(values) - length, F.lit(0)) + 1, length)
    return F.concat(F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(values), F.lit(0))), cut)


def truncate(values: Column, length: int, side: str = "right") -> Column:
    """Keeps ``length`` values. side: what is cut off, or "middle", or "error"."""
    n, over = F.size(values), F.size(values) > length
    if side == "right":
        return F.slice(values, 1, length)
    if side == "left":
        return F.when(over, F.slice(values, n - length + 1, length)).otherwise(values)
    if side == "middle":
        left = length // 2
        right = length - left
        return F.when(over, F.concat(F.slice(values, 1, left), F.slice(values, n - right + 1, right))).otherwise(values)
    if side == "error":
        return F.when(over, F.raise_error(F.lit(f"longer than {length}"))).otherwise(values)
    raise ValueError(f"unknown side {side!r}")


def without_padding(values: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x.m != 0), lambda x: x.v)


def logsumexp(values: Column) -> Column:
    return let(values, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top))))))


def entropy(logits: Column) -> Column:
    return let(logits, lambda v: let(logsumexp(v), lambda lse: lse - total(F.transform(v, lambda x: F.exp(x - lse) * x))))


def sum_pi_squared(logits: Column) -> Column:
    return let(logits, lambda v: F.exp(logsumexp(F.transform(v, lambda x: 2 * x)) - 2 * logsumexp(v)))


def logprob_of(logits: Column, label: Column) -> Column:
    return F.element_at(logits, label + 1) - logsumexp(logits)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(F.least(x, as_col(high)), as_col(low))


def on_last_token(reward: Column, length: Column) -> Column:
    """The reward on the last valid token, zeros before; empty for length 0."""
    spread = F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, reward).otherwise(0.0))
    return F.when(length > 0, spread).otherwise(F.array().cast("array<double>"))


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Per-token estimates of the divergence; a trailing + changes gradients only, not values."""
    kind = kind.rstrip("+")
    one = {
        "kl": lambda x, r: x - r, "k1": lambda x, r: x - r, "abs": lambda x, r: F.abs(x - r),
        "mse": lambda x, r: 0.5 * (x - r) * (x - r), "k2": lambda x, r: 0.5 * (x - r) * (x - r),
        "low_var_kl": lambda x, r: clip(F.exp(clip(r - x, -20.0, 20.0)) - clip(r - x, -20.0, 20.0) - 1, -10.0, 10.0),
    }
    one["k3"] = one["low_var_kl"]
    return F.zip_with(logp, ref, one[kind])


def _by_place(columns: list[pd.Series], step: Callable[..., np.ndarray], width: int = 1 << 22) -> pd.Series:
    """Backwards over places, all rows of a block at once: step(place, live rows, one padded matrix a column) gives the place's results."""
    out: list[np.ndarray] = []
    lengths = columns[0].map(lambda x: -1 if x is None else len(x)).to_numpy()
    at = 0
    while at < len(lengths):
        n = 1
        longest = max(int(lengths[at]), 1)
        while at + n < len(lengths) and (n + 1) * max(longest, int(lengths[at + n])) <= width:
            longest = max(longest, int(lengths[at + n]))
            n += 1
        padded = []
        for c in columns:
            m = np.zeros((n, longest))
            for i, x in enumerate(c.iloc[at : at + n]):
                if x is not None:
                    m[i, : len(x)] = x
            padded.append(m)
        result = np.zeros((n, longest))
        size = lengths[at : at + n]
        state = np.zeros((2, n))
        for t in range(longest - 1, -1, -1):
            result[:, t] = step(state, size > t, *(m[:, t] for m in padded))
        out += [None if k < 0 else result[i, :k] for i, k in enumerate(size)]
        at += n
    return pd.Series(out, dtype=object)


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Generalised advantages, backwards over time; masked places pass the state on and keep its advantage.

    A Pandas UDF: SQL has no running fold over an array that takes linear time.
    """

    def scan(r: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
        def step(state, live, r, v, m):
            on = live & (m != 0)
            state[1] = np.where(on, r + gamma * state[0] - v + gamma * lam * state[1], state[1])
            state[0] = np.where(on, v, state[0])
            return state[1]

        return _by_place([r, v, m], step)

    return F.pandas_udf(scan, "array<double>")(rewards, values, mask)


def returns_to_go(rewards: Column, gamma: float = 1.0) -> Column:
    """Discounted sums of what is still to come; a Pandas UDF as for ``gae``."""

    def scan(r: pd.Series) -> pd.Series:
        def step(state, live, r):
            state[0] = np.where(live, r + gamma * state[0], state[0])
            return state[0]

        return _by_place([r], step)

    return F.pandas_udf(scan, "array<double>")(rewards)


def importance_weights(old: Column, rollout: Column, mask: Column, level: str = "token", upper: float | None = 2.0, band: tuple[float, float] | None = None, log_bound: float = 20.0) -> Column:
    """exp(old - rollout) per token, or one weight per sequence on all its tokens.

    upper truncates; band zeroes what lies outside it. Log ratios are clipped before exp.
    """
    ratio = F.zip_with(old, rollout, lambda a, b: a - b)
    if level == "sequence":
        weights = let(F.exp(clip(masked_sum(ratio, mask), -log_bound, log_bound)), lambda whole: F.transform(mask, lambda m: whole))
    else:
        weights = F.transform(ratio, lambda x: F.exp(clip(x, -log_bound, log_bound)))
    if band:
        weights = F.transform(weights, lambda w: F.when((w >= band[0]) & (w <= band[1]), w).otherwise(0.0))
    elif upper is not None:
        weights = F.transform(weights, lambda w: F.least(w, F.lit(upper)))
    return F.zip_with(weights, mask, lambda w, m: w * m)


def rejection_mask(old: Column, rollout: Column, mask: Column, mode: str, low: float | None, high: float) -> Column:
    """The mask without what a rejection mode drops. Modes: token_k1..k3, seq_sum_k1..k3, seq_mean_k1..k3, seq_max_k2, seq_max_k3."""
    level, _, kind = mode.rpartition("_")
    ratio = F.zip_with(old, rollout, lambda a, b: a - b)
    div = {"k1": lambda x: -x, "k2": lambda x: 0.5 * x * x, "k3": lambda x: F.exp(x) - x - 1}[kind]
    each = F.transform(ratio, div)
    if kind == "k1":  # compared as a ratio
        inside = lambda d: (F.exp(-d) >= (low or 0.0)) & (F.exp(-d) <= high)
    else:
        inside = lambda d: d <= high
    if level == "token":
        return F.zip_with(mask, each, lambda m, d: F.when((m != 0) & inside(d), 1).otherwise(0))
    if level == "seq_max":
        whole = F.array_max(F.zip_with(each, mask, lambda d, m: F.when(m != 0, d)))
    else:
        whole = masked_sum(each, mask)
        whole = whole / F.greatest(mask_count(mask), F.lit(1.0)) if level == "seq_mean" else whole
    return let(F.coalesce(inside(whole), F.lit(False)), lambda ok: F.transform(mask, lambda m: F.when((m != 0) & ok, 1).otherwise(0)))


def threshold(text: str | float) -> tuple[float | None, float]:
    """"lo_hi" or one number as (low, high); one number has low 1/high."""
    if isinstance(text, bool):
        raise TypeError("a threshold is a number or lo_hi")
    low, _, high = str(text).rpartition("_")
    value = float(high)
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"bad threshold {text!r}")
    return (float(low) if low else 1 / value), value
