"""Exact Gaussian likelihood of autoregressive moving-average series.

A series is w[t] = sum of -ar[k] w[t-k] + e[t] + sum of ma[k] e[t-k], in the state-space
form of Harvey (1989): the state has as many entries as the longer of both polynomials
needs. The state begins with its stationary covariance, so the prediction errors and their
variances decompose the density of the whole series. The errors of a time-invariant
model need no covariance matrices: its increments have rank one and are carried as a
vector and a factor (the Chandrasekhar recursions; Morf, Sidhu and Kailath, 1974), and
many parameter vectors go through the recursion side by side.

Differences are taken before: given the values that the differences use up at the begin,
the density of what is left is that of the differenced series, which is the likelihood of
the undifferenced one under a diffuse start."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Squarings of the transition matrix after which a process counts as not stationary.
DOUBLINGS = 40


def shifted(x: np.ndarray) -> np.ndarray:
    """Entries one place up, along the last axis; the last one is 0."""
    out = np.zeros_like(x)
    out[..., :-1] = x[..., 1:]
    return out


@dataclass
class Models:
    """Models side by side: ``ar`` and ``ma`` (models, lags + 1) from lag 0 on (1)."""

    ar: np.ndarray
    ma: np.ndarray

    def __post_init__(self) -> None:
        self.size = max(self.ar.shape[1] - 1, self.ma.shape[1], 1)
        self.phi = np.zeros((len(self.ar), self.size))
        self.phi[:, : self.ar.shape[1] - 1] = -self.ar[:, 1:]
        self.shock = np.zeros((len(self.ma), self.size))
        self.shock[:, : self.ma.shape[1]] = self.ma

    def moved(self, state: np.ndarray) -> np.ndarray:
        """The transition of states (models, size)."""
        return self.phi * state[:, :1] + shifted(state)

    def transition(self) -> np.ndarray:
        out = np.zeros((len(self.phi), self.size, self.size))
        out[:, :, 0] = self.phi
        out[:, np.arange(self.size - 1), np.arange(1, self.size)] = 1.0
        return out

    def stationary(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariances of the states in units of the shocks' variance, by doubling, and
        which models are stationary."""
        step = self.transition()
        total = self.shock[:, :, None] * self.shock[:, None, :]
        good = np.ones(len(step), bool)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(DOUBLINGS):
                more = step @ total @ step.transpose(0, 2, 1)
                total = total + more
                good &= np.isfinite(total).all((1, 2)) & (np.abs(total).max((1, 2), initial=0.0) < 1e12)
                total[~good], step[~good] = 0.0, 0.0
                if not (np.abs(more[good]) > 1e-14 * np.abs(total[good]).max((1, 2), keepdims=True)).any():
                    return total, good
                step = step @ step
        good &= np.abs(step).max((1, 2)) < 1e-6
        return total, good


@dataclass
class Filtered:
    """Prediction errors (models, n) and their variances in units of the shocks', what is
    predicted of the next state, and which models could be filtered."""

    errors: np.ndarray
    variances: np.ndarray
    state: np.ndarray
    covariance: np.ndarray | None
    good: np.ndarray


def filtered(models: Models, w: np.ndarray, keep_covariance: bool = False) -> Filtered:
    """The filter over series ``w`` (models, n), one for each model."""
    cov, good = models.stationary()
    n, phi = w.shape[1], models.phi
    variance = np.where(good, cov[:, 0, 0], 1.0)
    gain = models.moved(cov[:, :, 0])  # times the variance
    factor = -1.0 / variance
    both = np.stack([np.zeros_like(phi), gain])  # the state, and the increment's vector
    errors, variances = np.empty(w.shape), np.empty(w.shape)
    settled = False  # covariances no longer change
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for t in range(n):
            error, lead = w[:, t] - both[0, :, 0], both[1, :, 0]
            errors[:, t], variances[:, t] = error, variance
            if settled:
                state = phi * both[0, :, :1] + gain * (error / variance)[:, None]
                state[:, :-1] += both[0, :, 1:]
                both[0] = state
                continue
            if keep_covariance:
                cov = cov + factor[:, None, None] * both[1, :, :, None] * both[1, :, None, :]
            ahead = phi * both[:, :, :1]
            ahead[:, :, :-1] += both[:, :, 1:]
            pull, before = factor * lead, variance
            ahead[0] += gain * (error / variance)[:, None]
            variance = variance + pull * lead
            gain = gain + ahead[1] * pull[:, None]
            ahead[1] -= gain * (lead / variance)[:, None]
            factor = factor + pull * pull / before
            both = ahead
            settled = t % 8 == 7 and not keep_covariance and bool((np.abs(factor) * (both[1] ** 2).max(1) < 1e-15 * variance)[good].all())
        good = good & np.isfinite(errors).all(1) & (variances > 0).all(1) & np.isfinite(variances).all(1)
    return Filtered(errors, variances, both[0], cov if keep_covariance else None, good)


def log_likelihood(f: Filtered, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(log density of the values from ``first`` on given those before, variance of the
    shocks) of each model; the variance is the likeliest over the whole series."""
    n = f.errors.shape[1]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        sigma2 = np.maximum((f.errors**2 / f.variances).sum(1) / n, 1e-300)
        each = -0.5 * (np.log(2 * np.pi * sigma2[:, None] * f.variances) + f.errors**2 / (f.variances * sigma2[:, None]))
        value = each[:, first:].sum(1)
    return np.where(f.good & np.isfinite(value), value, -np.inf), sigma2


#: Lengths that a step is tried at, all at once.
STEPS = 2.0 ** -np.arange(0, 14)


def maximise(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 300, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton steps (BFGS) with differences for slopes; ``f`` values many points at
    once. The best point, its value, and whether it settled."""
    n = len(start)
    at, value = start.astype(float), float(f(start[None])[0])
    if not n:
        return at, value, np.isfinite(value)
    width = 1e-5

    def slope(x: np.ndarray) -> np.ndarray:
        around = f(np.concatenate([x + width * np.eye(n), x - width * np.eye(n)]))
        up, down = around[:n], around[n:]
        with np.errstate(invalid="ignore"):
            out = (up - down) / (2 * width)
            # beside a bound only one side counts
            out = np.where(np.isfinite(up) & np.isfinite(down), out, np.where(np.isfinite(up), (up - value) / width, (value - down) / width))
        return np.where(np.isfinite(out), out, 0.0)

    inverse, gradient = np.eye(n), slope(at)
    inverse /= max(1.0, np.linalg.norm(gradient))
    fresh = True
    for _ in range(rounds):
        direction = inverse @ gradient
        if direction @ gradient <= 0:
            inverse, direction = np.eye(n) / max(1.0, np.linalg.norm(gradient)), gradient / max(1.0, np.linalg.norm(gradient))
        tried = f(at + STEPS[:, None] * direction)
        best = int(np.argmax(tried))
        gained = tried[best] - value
        if not gained > tol * (1 + abs(value)):
            if fresh:
                return at, value, bool(np.isfinite(value))
            inverse, fresh = np.eye(n) / max(1.0, np.linalg.norm(gradient)), True
            continue
        moved = STEPS[best] * direction
        at, value, fresh = at + moved, float(tried[best]), False
        new = slope(at)
        fall = gradient - new
        gradient = new
        if (along := moved @ fall) > 1e-12:
            left = np.eye(n) - np.outer(moved, fall) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
    return at, value, False
