"""Curve fits and recurrences of one series, in numpy: helpers of the grouped forecasts, a group being one title's or label's weeks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

#: Weeks of the baseline's median and the least of them; what counts as nothing; the ratio from which a series spikes.
BASELINE_WEEKS, BASELINE_LEAST, NOTHING, SPIKE_RATIO = 52, 8, 1e-6, 1.5
#: A title is old from these weeks, large from this volume; its multiplier does not fall below the last value while it is steady.
OLD_WEEKS, LARGE_VOLUME, STEADY_CV, STEADY_LEAST, MOST = 156, 5_000_000, 0.15, 0.99, 5.0
#: Releases from which an artist's own second week counts in full; the floor's greatest part of the last known week.
BLEND_RELEASES, FLOOR_CAP = 4.0, 0.95


def nnls(a: np.ndarray, b: np.ndarray, solve: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Non-negative least squares by an active set: the column that helps most joins, and those that would turn negative leave.

    solve: least squares on some of the columns, where the matrix is that of many fits.
    """
    solve = solve or (lambda used, b: np.linalg.lstsq(a[:, used], b, rcond=None)[0])
    n = a.shape[1]
    scale = np.linalg.norm(a, axis=0)
    least = 1e-10 * np.maximum(scale, 1e-300) * np.linalg.norm(b)
    used, x = np.zeros(n, bool), np.zeros(n)
    for _ in range(3 * n):
        slope = a.T @ (b - a @ x)
        waiting = np.where(~used & (slope > least), slope / np.maximum(scale, 1e-300), -np.inf)
        if not np.isfinite(waiting).any():
            break
        used[waiting.argmax()] = True
        while used.any():
            fit = np.zeros(n)
            fit[used] = solve(used, b)
            if (fit[used] > 0).all():
                x = fit
                break
            out = used & (fit <= 0)
            step = np.min(x[out] / np.maximum(x[out] - fit[out], 1e-300))
            x = np.maximum(x + step * (fit - x), 0)
            used &= ~(out & (x <= 1e-14 * max(1.0, x.max())))
            x[~used] = 0
    return x


def gamma_curve(t: np.ndarray, peak: float, a: float | np.ndarray) -> np.ndarray:
    """1 at the peak, rising before and falling after it."""
    return (t / peak) ** a * np.exp(-a * (t / peak - 1))


class Basis:
    """A matrix that many series are fitted to: the inverses of its choices of columns are made once each. inverses: those of other matrices too, which ``key`` tells apart."""

    #: Fixed value: inverses that are kept.
    MOST = 50_000

    def __init__(self, a: np.ndarray, key: tuple = (), inverses: dict | None = None):
        self.a, self.key, self.inverses = a, key, {} if inverses is None else inverses

    def solve(self, used: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (*self.key, used.tobytes())
        found = self.inverses.get(key)
        if found is None:
            if len(self.inverses) >= self.MOST:
                self.inverses.clear()
            chosen = self.a[:, used]
            found = self.inverses[key] = np.linalg.pinv(chosen, rcond=np.finfo(float).eps * max(chosen.shape))
        return found @ b

    def fit(self, b: np.ndarray) -> np.ndarray:
        return nnls(self.a, b, self.solve)


class Curves:
    """The archetypes' curves (weeks x archetypes) by week of the peak, made once each."""

    #: Fixed value: peaks that are kept.
    MOST = 1024

    def __init__(self, sharpness: Sequence[float]):
        self.sharpness, self.known, self.inverses = sharpness, {}, {}

    def at(self, weeks: int, peak: int) -> np.ndarray:
        """Weeks 1 to ``weeks``."""
        known = self.known.get(peak)
        if known is None or len(known) < weeks:
            if len(self.known) >= self.MOST:
                self.known.clear()
            t = np.arange(1, max(weeks, 160) + 1.0)
            known = self.known[peak] = np.stack([gamma_curve(t, float(peak), a) for a in self.sharpness], 1)
        return known[:weeks]

    def basis(self, weeks: int, peak: int) -> Basis:
        return Basis(self.at(weeks, peak), (weeks, peak), self.inverses)


@lru_cache(maxsize=4)
def curves_of(sharpness: tuple[float, ...]) -> Curves:
    """The curves of a worker, whatever the number of its tasks."""
    return Curves(sharpness)


def backfill(
    y: np.ndarray, priors: np.ndarray, sharpness: np.ndarray, floor: float, end_week: int, multiplier: float = 1.0, fit_weight: float = 0.5, margin: int = 3
) -> np.ndarray:
    """Weeks 1 to ``end_week``: those of ``y`` as they are, the rest by the mix of archetypes that fits them.

    priors, sharpness: of each archetype, its chance and the exponent of its curve. For each possible week of the peak, the
    non-negative mix that fits is blended with the priors and scaled; the week with the least squared error of logarithms is
    taken. The curve is then anchored to the floor and to the last known week; ``multiplier`` changes what is above the floor later on.
    """
    return backfills(y, priors, Curves(sharpness), floor, end_week, (multiplier,), fit_weight, margin)[0]


def backfills(
    y: np.ndarray, priors: np.ndarray, curves: Curves, floor: float, end_week: int, multipliers: Sequence[float] = (1.0,), fit_weight: float = 0.5, margin: int = 3
) -> list[np.ndarray]:
    """``backfill`` for several multipliers, from one fit."""
    k = len(y)
    y = np.maximum(y, 0.0)
    if not k or y.max() <= 0:
        return [np.concatenate([y, np.full(max(0, end_week - k), floor)]) for _ in multipliers]
    observed = int(y.argmax()) + 1
    latest = observed if observed < k else min(end_week, observed + margin)
    priors = priors / priors.sum()
    best, error = (observed, priors, float(y.max())), np.inf
    for peak in range(observed, latest + 1):
        basis = curves.basis(k, peak)
        g, raw = basis.a, basis.fit(y / y.max())
        if raw.sum() <= 0:
            continue
        mix = (1 - fit_weight) * priors + fit_weight * raw / raw.sum()
        shape = g @ mix
        volume = max(0.0, float(y @ shape / (shape @ shape)))
        sse = float(((np.log1p(y) - np.log1p(volume * shape)) ** 2).sum())
        if sse < error:
            best, error = (peak, mix, volume), sse
    peak, mix, volume = best
    floor = min(floor, FLOOR_CAP * y[-1]) if y[-1] > 0 else floor
    path = np.maximum(max(volume - floor, 0.0) * (curves.at(end_week, peak) @ mix) + floor, 0.0)
    above = path[k - 1] - floor
    if above > 1e-12 and y[-1] >= floor:
        path = np.maximum(floor + (y[-1] - floor) / above * (path - floor), floor)
    elif path[k - 1] > 1e-12 and floor <= 1e-12:
        path = np.maximum(path * y[-1] / path[k - 1], 0.0)
    ahead = path[k:]
    return [np.concatenate([y, floor + np.maximum(ahead - floor, 0.0) * m if m != 1.0 else ahead]) for m in multipliers]


def spliced(channels: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Curves of channels (weeks x channels), whose future is scaled so that their sum goes on from the last known total. known: the first weeks."""
    k = len(known)
    out = channels.copy()
    if 0 < k < len(out):
        at_boundary = out[k - 1].sum()
        if abs(at_boundary) > 1e-12:
            out[k:] *= known[-1].sum() / at_boundary
    out[:k] = known
    return out


def ridge_fit(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients and intercept (last) of ridge regression, the intercept without penalty, from centred moments."""
    mx, my = x.mean(0), y.mean()
    xc = x - mx
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return np.append(w, my - mx @ w)


def seasonal_terms(day: np.ndarray, order: int, first: float, span: float) -> np.ndarray:
    """Trend and yearly waves of days (numbers): 1, t, and sine and cosine for each order."""
    turn = 2 * np.pi * day / 365.25
    return np.stack([np.ones(len(day)), (day - first) / span, *(f(k * turn) for k in range(1, order + 1) for f in (np.sin, np.cos))], 1)


#: Change points of a trend, in which first part of the series they lie, the scale of rate changes and of waves.
CHANGE_POINTS, CHANGE_PART, CHANGE_SCALE, WAVE_SCALE = 25, 0.8, 0.05, 10.0


def penalised(gram: np.ndarray, moment: np.ndarray, absolute: np.ndarray, square: np.ndarray, close: float = 1e-11, sweeps: int = 20_000) -> np.ndarray:
    """The least of w' gram w / 2 - moment' w + sum of absolute |w| + sum of square w^2 / 2, by coordinate descent on sums.

    Coefficients without an absolute penalty follow from the others in closed form, so the descent goes over the others only.
    """
    free = absolute == 0
    whole = gram + np.diag(square)
    left = np.linalg.lstsq(whole[np.ix_(free, free)], np.column_stack([whole[np.ix_(free, ~free)], moment[free]]), rcond=None)[0]
    across, alone = left[:, :-1], left[:, -1]
    inner = whole[np.ix_(~free, ~free)] - whole[np.ix_(~free, free)] @ across
    wanted = moment[~free] - whole[np.ix_(~free, free)] @ alone
    w, slope, penalty, diagonal = np.zeros(len(wanted)), -wanted, absolute[~free], np.diag(inner)  # slope: inner w - wanted
    for _ in range(sweeps if len(w) else 0):
        most = 0.0
        for j in np.flatnonzero((w != 0) | (np.abs(slope) > penalty)):
            pull = diagonal[j] * w[j] - slope[j]
            new = np.sign(pull) * max(abs(pull) - penalty[j], 0.0) / max(diagonal[j], 1e-300)
            if new != w[j]:
                slope = slope + inner[:, j] * (new - w[j])
                most, w[j] = max(most, abs(new - w[j]) * np.sqrt(diagonal[j])), new
        if most <= close:
            break
    out = np.zeros(len(moment))
    out[~free], out[free] = w, alone - across @ w
    return out


def trend_terms(day: np.ndarray, order: int) -> np.ndarray:
    """Level, trend, what a change of its rate at each change point adds, and yearly waves; days ascending."""
    t = (day - day[0]) / max(1.0, day[-1] - day[0])
    known = t[: max(1, int(np.floor(len(t) * CHANGE_PART)))]
    n = min(CHANGE_POINTS, len(known) - 1)
    points = known[np.round(np.linspace(0, len(known) - 1, n + 1)).astype(int)[1:]] if n > 0 else np.zeros(0)
    waves = seasonal_terms(day, order, day[0], 1.0)[:, 2:]
    return np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - points, 0), waves])


def trend_fit(day: np.ndarray, y: np.ndarray, order: int = 2, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, fitted values, and the penalty on rate changes: a piecewise linear trend whose changes have a Laplace prior, and waves with a normal one.

    The values are scaled by the greatest; the variance of the noise, on which the penalties depend, is that of the last round's residuals.
    """
    scale = max(float(np.abs(y).max()), 1e-300)
    z, x = y / scale, trend_terms(day, order)
    changes = np.zeros(x.shape[1], bool)
    changes[2 : x.shape[1] - 2 * order] = True
    waves = np.arange(x.shape[1]) >= x.shape[1] - 2 * order
    gram, moment = x.T @ x, x.T @ z
    plain = ~changes
    w = np.zeros(x.shape[1])
    w[plain], *_ = np.linalg.lstsq(x[:, plain], z, rcond=None)
    absolute = np.zeros(len(w))
    for _ in range(rounds):
        variance = max(float(np.mean((z - x @ w) ** 2)), 1e-12)
        absolute = np.where(changes, variance / CHANGE_SCALE, 0.0)
        w = penalised(gram, moment, absolute, np.where(waves, variance / WAVE_SCALE**2, 0.0))
    return w * scale, x @ w * scale, absolute
