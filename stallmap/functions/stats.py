"""Column functions of the two-stage test: Wilson bounds, first stage, second stage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallmap.constants import ALPHAS, BACKGROUND_STOP, BISECT_STEPS, BISECT_TOLERANCE, MIN_STOP_FRACTION, Z_VALUES


def fraction(rss: Column, cov: Column) -> Column:
    """Share of the reads over a position that start there; null where nothing covers it."""
    return F.try_divide(rss.cast("double"), cov.cast("double"))


def wilson(p: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a proportion p of n."""
    n = n.cast("double")
    d = 1 + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    return centre - half, centre + half


def margin(rss_t: Column, cov_t: Column, rss_c: Column, cov_c: Column, z: float) -> Column:
    """Lower bound of the treatment's fraction less the upper bound of the control's."""
    low, _ = wilson(rss_t / cov_t, cov_t, z)
    _, high = wilson(rss_c / cov_c, cov_c, z)
    return low - high


def first_alpha(share: Column, margins: Sequence[Column]) -> Column:
    """The strictest alpha up to which every margin is at least 0; 0 if none is or the treatment's share is too low."""
    passed = F.lit(0)
    for m in reversed(margins):
        passed = F.when(m >= 0, passed + 1).otherwise(0)
    found = F.element_at(F.array(*[F.lit(a) for a in (0.0, *ALPHAS)]), passed + 1)
    return F.when(share < MIN_STOP_FRACTION, F.lit(0.0)).otherwise(found)


def first_stage(rss_t: Column, cov_t: Column, rss_c: Column, cov_c: Column) -> Column:
    return first_alpha(rss_t / cov_t, [margin(rss_t, cov_t, rss_c, cov_c, z) for z in Z_VALUES])


#: The published rational form of the normal quantile, from the highest power down. Near the middle in
#: 0.180625 - q * q with q = p - 0.5, else in r - 1.6 with r = sqrt(-log(1 - p)).
NEAR = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
FAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
MIDDLE = 0.425


def two_sided_quantile(alpha: np.ndarray) -> np.ndarray:
    """z with a share of alpha of the normal distribution beyond -z and z, for alphas of 1e-10 to 1."""
    p = 1 - np.asarray(alpha, float) / 2
    q, r = p - 0.5, np.sqrt(-np.log(1 - p)) - 1.6
    near, far = 0.180625 - q * q, r
    return np.where(q <= MIDDLE, np.polyval(NEAR[0], near) * q / np.polyval(NEAR[1], near), np.polyval(FAR[0], far) / np.polyval(FAR[1], far))


def _upper(alpha: np.ndarray, n: np.ndarray) -> np.ndarray:
    z = two_sided_quantile(alpha)
    p, d = BACKGROUND_STOP, 1 + z * z / n
    return (p + z * z / (2 * n)) / d + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d


def bisect_alpha(rest: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each margin the alpha at which the background's upper bound over n reads reaches it, between the
    loosest and strictest alpha; nan if it is above the margin even at the loosest."""
    loose, strict = ALPHAS[0], ALPHAS[-1]
    out = np.full(len(rest), np.nan)
    ok = rest - _upper(np.full(len(rest), loose), n) >= 0
    top = ok & (rest - _upper(np.full(len(rest), strict), n) >= 0)
    out[top] = strict
    at = np.flatnonzero(ok & ~top)
    high, low = np.full(len(at), loose), np.full(len(at), strict)
    for step in range(1, BISECT_STEPS + 1):
        if not len(at):
            break
        test = (high + low) / 2
        result = rest[at] - _upper(test, n[at])
        done = (np.abs(result) < BISECT_TOLERANCE) | (step == BISECT_STEPS)
        out[at[done]] = test[done]
        high, low = np.where(result > 0, test, high)[~done], np.where(result > 0, low, test)[~done]
        at = at[~done]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _second_stage(cov_t: pd.Series, margins: pd.Series) -> pd.Series:
    n, rest = cov_t.to_numpy(float), np.array(margins.tolist(), float).reshape(-1, len(ALPHAS))
    found = np.stack([bisect_alpha(rest[:, k], n) for k in range(len(ALPHAS))], axis=1)
    lengths = np.where(np.isnan(found).any(axis=1), np.isnan(found).argmax(axis=1), len(ALPHAS))
    return pd.Series([row[:m].tolist() if m else None for row, m in zip(found, lengths)])


def second_stage(cov_t: Column, margins: Sequence[Column]) -> Column:
    """For a prefix of the first-stage alphas, the second-stage alpha that each margin reaches; null if none.
    An Arrow function: its 17 masked steps work on whole batches."""
    return _second_stage(cov_t.cast("double"), F.array(*margins))
