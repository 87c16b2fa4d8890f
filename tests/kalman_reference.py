"""The Kalman filters in numpy, a batch of equally long tracks at once, to compare the DataFrame form with."""

import numpy as np

from wakeline.functions import geo
from wakeline.operators.models import MAX_ACCELERATION, MAX_MPS, MAX_TURN, MEASURED_M, NOISE, START


def _stack(rows):
    return np.stack([np.stack(r, axis=-1) for r in rows], axis=-2)


def _white(order: int, dt: np.ndarray, q: float) -> np.ndarray:
    """Discrete white noise of one axis: outer product of the integrated input."""
    g = [dt**2 / 2, dt] if order == 2 else [dt**2 / 2, dt, np.ones_like(dt)]
    g = np.stack(g, axis=-1)
    return q * g[:, :, None] * g[:, None, :]


def _transition(kind: str, dt: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and process noise of a batch of samples."""
    one, zero = np.ones_like(dt), np.zeros_like(dt)
    if kind == "turn":
        w = np.where(np.abs(x[:, 4]) > 1e-6, x[:, 4], 1e-6)
        s, c = np.sin(w * dt), np.cos(w * dt)
        # w turns the course clockwise: east' = cos east + sin north, north' = cos north - sin east;
        # the way travelled is the integral of that over dt
        along, across = s / w, (1 - c) / w
        east = [one, along, zero, across, zero], [zero, c, zero, s, zero]
        north = [zero, -across, one, along, zero], [zero, -s, zero, c, zero]
        move = _stack([*east, *north, [zero, zero, zero, zero, one]])
        p, v, t = NOISE["position"] ** 2, NOISE["velocity"] ** 2, NOISE["turn"] ** 2
        q = np.zeros_like(move)
        for i, n in enumerate((p * dt**2, v * dt, p * dt**2, v * dt, t * dt)):
            q[:, i, i] = n
        return move, q
    n = 2 if kind == "velocity" else 3
    block = _stack([[one, dt], [zero, one]]) if n == 2 else _stack(
        [[one, dt, dt**2 / 2], [zero, one, dt], [zero, zero, one]])
    noise = _white(n, dt, NOISE[kind] ** 2)
    move, q = np.zeros((len(dt), 2 * n, 2 * n)), np.zeros((len(dt), 2 * n, 2 * n))
    for k in (0, n):
        move[:, k:k + n, k:k + n], q[:, k:k + n, k:k + n] = block, noise
    return move, q


def _capped(kind: str, x: np.ndarray) -> np.ndarray:
    vx, vy = (1, 4) if kind == "acceleration" else (1, 3)
    speed = np.hypot(x[:, vx], x[:, vy])
    scale = np.where(speed > MAX_MPS, MAX_MPS / np.maximum(speed, 1e-12), 1.0)
    x[:, vx] *= scale
    x[:, vy] *= scale
    if kind == "acceleration":
        a = np.hypot(x[:, 2], x[:, 5])
        scale = np.where(a > MAX_ACCELERATION, MAX_ACCELERATION / np.maximum(a, 1e-12), 1.0)
        x[:, 2] *= scale
        x[:, 5] *= scale
    if kind == "turn":
        x[:, 4] = np.clip(x[:, 4], -MAX_TURN, MAX_TURN)
    return x


def kalman_batch(kind: str, lat: np.ndarray, lon: np.ndarray, t: np.ndarray, horizon: int):
    """Filter a batch of equally long tracks and extrapolate them.

    Arrays are (samples, fixes).  Returns lat, lon and the three entries of the
    position covariance, each (samples, horizon).
    """
    ref_lat, ref_lon = lat.mean(axis=1, keepdims=True), lon.mean(axis=1, keepdims=True)
    per_lat = geo.M_PER_DEG
    per_lon = geo.M_PER_DEG * np.cos(np.radians(ref_lat))
    x_m, y_m = (lon - ref_lon) * per_lon, (lat - ref_lat) * per_lat
    dt = np.maximum(np.diff(t, axis=1), 1e-6)
    vx, vy = np.diff(x_m, axis=1) / dt, np.diff(y_m, axis=1) / dt
    if kind == "velocity":
        state, spread, iy = [x_m[:, -1], vx[:, -1], y_m[:, -1], vy[:, -1]], ["position", "velocity"] * 2, 2
    elif kind == "turn":
        course = np.arctan2(vx, vy)
        swing = (np.diff(course, axis=1) + np.pi - 1e-9) % (2 * np.pi) - np.pi + 1e-9
        omega = (swing / dt[:, 1:])[:, -3:].mean(axis=1)
        state = [x_m[:, -1], vx[:, -1], y_m[:, -1], vy[:, -1], omega]
        spread, iy = ["position", "velocity"] * 2 + ["turn"], 2
    else:
        ax, ay = (np.diff(v, axis=1)[:, -1] / dt[:, -1] for v in (vx, vy))
        state = [x_m[:, -1], vx[:, -1], ax, y_m[:, -1], vy[:, -1], ay]
        spread, iy = ["position", "velocity", "acceleration"] * 2, 3
    x = np.stack(state, axis=1)
    size = x.shape[1]
    cov = np.tile(np.diag([START[s] ** 2 for s in spread]), (len(x), 1, 1))
    see = np.zeros((2, size))
    see[0, 0] = see[1, iy] = 1.0
    noise = np.eye(2) * MEASURED_M**2

    def advance(x, cov, step):
        move, q = _transition(kind, step, x)
        return (move @ x[:, :, None])[:, :, 0], move @ cov @ move.transpose(0, 2, 1) + q

    fixes = lat.shape[1]
    for i in range(max(1, fixes - (3 if kind == "turn" else 5)), fixes):
        x, cov = advance(x, cov, dt[:, i - 1])
        gain = cov @ see.T @ np.linalg.inv(see @ cov @ see.T + noise)
        miss = np.stack([x_m[:, i], y_m[:, i]], axis=1) - x @ see.T
        x = x + (gain @ miss[:, :, None])[:, :, 0]
        keep = np.eye(size) - gain @ see
        cov = keep @ cov @ keep.transpose(0, 2, 1) + gain @ noise @ gain.transpose(0, 2, 1)
    step = np.maximum(np.diff(t[:, -3:], axis=1).mean(axis=1), 1e-6)
    out = []
    for _ in range(horizon):
        x, cov = advance(x, cov, step)
        x = _capped(kind, x)
        out.append((x[:, iy] / per_lat + ref_lat[:, 0], x[:, 0] / per_lon[:, 0] + ref_lon[:, 0],
                    cov[:, 0, 0], cov[:, iy, iy], cov[:, 0, iy]))
    return [np.stack(part, axis=1) for part in zip(*out)]
