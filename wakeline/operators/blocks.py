"""Neighbours of each row counted and compared in arrays, where pairs would outgrow their rows.

A block holds the rows of one time bucket and cell, ``_home`` rows of their own and
copies of those around it whose circle touches the cell.  Home rows meet the whole
block in pieces of at most PIECE pairs, so a task holds a block's rows and one piece;
what leaves a block is linear in its home rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from wakeline.functions import geo

PIECE = 1 << 16
TILE = 2048
#: How much a pair may exceed the least one and still be compared exactly outside: metres.
NEAREST_M, WORST_M = 1e-5, 1e-4
STILL = 1e-10


def blocks(batches: Iterable[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of one key after the other, of batches sorted by the key."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if held and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


class Block:
    """One block's columns in order of latitude; ``mine`` are the places of its home rows."""

    def __init__(self, table: pa.Table, radius_km: float, same_vessel: bool, moving: bool = False):
        col = lambda c: table.column(c).to_numpy()[self.order]
        lat = table.column("lat").to_numpy()
        self.order = np.argsort(lat, kind="stable")
        self.lat, self.lon, self.ids, self.mmsi = lat[self.order], col("lon"), col("event_id"), col("mmsi") if not same_vessel else None
        phi, lam = np.radians(self.lat), np.radians(self.lon)
        self.xyz = (np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi))
        self.limit = (2 * math.sin(min(radius_km / geo.EARTH_KM, math.pi) / 2)) ** 2
        reach = math.degrees(radius_km / geo.EARTH_KM) * (1 + 1e-9)
        self.mine = np.flatnonzero(table.column("_home").to_numpy()[self.order])
        self.lo = np.searchsorted(self.lat, self.lat[self.mine] - reach)
        self.hi = np.searchsorted(self.lat, self.lat[self.mine] + reach, "right")
        if moving:
            # the row's own terms of collision.with_cpa, one number at a time as there
            v, turn = col("sog") * geo.KNOTS_TO_MPS, [c * (math.pi / 180) for c in (90.0 - col("cog")).tolist()]
            self.vx, self.vy = v * np.array([math.cos(a) for a in turn]), v * np.array([math.sin(a) for a in turn])
            self.wide = np.array([math.cos(a * (math.pi / 180)) for a in self.lat.tolist()]) * geo.M_PER_DEG

    def pieces(self, most: int = PIECE) -> Iterator[tuple[slice, int, int]]:
        """(home rows, first and last place of what they can meet)."""
        i = 0
        while i < len(self.mine):
            j = i + 1
            while j < len(self.mine) and (j + 1 - i) * (self.hi[j] - self.lo[i]) <= most:
                j += 1
            yield slice(i, j), self.lo[i], self.hi[j - 1]
            i = j

    def near(self, rows: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(is the pair near, squared chord) of the rows against places a to b."""
        chord = 0.0
        for axis in self.xyz:
            apart = axis[a:b] - axis[rows][:, None]
            apart *= apart
            chord = chord + apart
        near = chord < self.limit
        near &= self.ids[a:b] != self.ids[rows][:, None]
        if self.mmsi is not None:
            near &= self.mmsi[a:b] != self.mmsi[rows][:, None]
        return near, chord


def _least(values: np.ndarray, ids: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of values whose root is at most ``slack`` above the row's least; of equal ones that of the smallest id."""
    most = (np.sqrt(values.min(axis=1)) + slack) ** 2
    rows, cols = np.nonzero((values <= most[:, None]) & np.isfinite(values))
    if len(rows) > len(values) or (rows[1:] == rows[:-1]).any():
        found = values[rows, cols]
        order = np.lexsort((ids[cols], found, rows))
        rows, cols, found = rows[order], cols[order], found[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        rows, cols = rows[first], cols[first]
    return rows, cols


def summaries(table: pa.Table, state: Sequence[str], radius_km: float, same_vessel: bool, pick: str | None, measured: bool) -> pa.Table:
    """Rows of :func:`proximity.near_summaries` for one block."""
    moving = pick == "worst" or measured
    block = Block(table, radius_km, same_vessel, moving)
    mine, others, parts = [], [], []
    for rows, a, b in block.pieces():
        own = block.mine[rows]
        near, chord = block.near(own, a, b)
        n = np.count_nonzero(near, axis=1)
        if not n.any():
            continue
        has = n > 0
        if not has.all():
            own, near, chord, n = own[has], near[has], chord[has], n[has]
        out = {"n": n}
        if moving:
            dx = (block.lon[a:b] - block.lon[own][:, None]) * block.wide[own][:, None]
            dy = (block.lat[a:b] - block.lat[own][:, None]) * geo.M_PER_DEG
            dvx, dvy = block.vx[a:b] - block.vx[own][:, None], block.vy[a:b] - block.vy[own][:, None]
            rel2 = dvx * dvx + dvy * dvy
            still = rel2 < STILL
            t = -(dx * dvx + dy * dvy) / np.where(still, 1.0, rel2)
            t[still] = 0.0
            out["tcpa_min"] = np.where(near & (t > 0), t, np.inf).min(axis=1)
        if measured:
            km = 2 * geo.EARTH_KM * np.arcsin(np.minimum(np.sqrt(chord) / 2, 1.0))
            out["distance_sum"] = np.where(near, km, 0.0).sum(axis=1) / geo.KM_PER_NM
            out["distance_min"] = np.where(near, km, np.inf).min(axis=1) / geo.KM_PER_NM
            out["knots_sum"] = np.where(near, np.sqrt(rel2) / geo.KNOTS_TO_MPS, 0.0).sum(axis=1)
        if pick is None:
            at, to = np.arange(len(own)), None
        elif pick == "nearest":
            at, to = _least(np.where(near, chord, np.inf), block.ids[a:b], NEAREST_M / geo.EARTH_M)
        else:
            ex, ey = dx + dvx * t, dy + dvy * t
            at, to = _least(np.where(near, ex * ex + ey * ey, np.inf), block.ids[a:b], WORST_M)
        mine.append(block.order[own[at]])
        if to is not None:
            others.append(block.order[a + to])
        # a row's sums stand once, with the first of what is compared outside
        once = np.ones(len(at), bool)
        once[1:] = at[1:] != at[:-1]
        parts.append({k: np.where(once, v[at], np.inf if k.endswith("_min") else 0) for k, v in out.items()})
    if not mine:
        return None
    own = table.select(list(state)).take(pa.array(np.concatenate(mine)))
    cols = {c: own.column(c) for c in state}
    if others:
        there = table.select(list(state)).take(pa.array(np.concatenate(others)))
        cols |= {f"other_{c}": there.column(c) for c in state}
    cols |= {k: pa.array(np.concatenate([p[k] for p in parts])) for k in parts[0]}
    return pa.table(cols)


def triangles(table: pa.Table, radius_km: float, same_vessel: bool) -> tuple[int, float]:
    """(sum of degrees, sum of local clustering) of a block's home rows.

    The edges among a row's neighbours are counted by products of 0/1 matrices, a tile at a time.
    """
    block = Block(table, radius_km, same_vessel)
    n, ends, shares = len(block.lat), 0, 0.0
    tiles = [(a, min(a + TILE, n)) for a in range(0, n, TILE)]
    link = lambda k, j: block.near(np.arange(*k), *j)[0].astype(np.float32)
    whole = link((0, n), (0, n)) if n <= 2 * TILE else None
    step = max(1, (TILE * TILE * 4) // max(1, n))
    for at in range(0, len(block.mine), step):
        own = block.mine[at:at + step]
        near = np.concatenate([block.near(own, *j)[0] for j in tiles], axis=1).astype(np.float32)
        seen = near.any(axis=0)
        degree, closed = near.sum(axis=1, dtype=np.float64), np.zeros(len(own))
        for j in tiles:
            if not seen[slice(*j)].any():
                continue
            if whole is not None:
                paths = near @ whole[:, slice(*j)]
            else:
                paths = sum(near[:, slice(*k)] @ link(k, j) for k in tiles if seen[slice(*k)].any())
            closed += (paths * near[:, slice(*j)]).sum(axis=1, dtype=np.float64)
        ends += int(degree.sum())
        some = degree > 1
        shares += float((closed[some] / (degree[some] * (degree[some] - 1))).sum())
    return ends, shares


def gathered(tables: Iterable[pa.Table], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tables as batches of some size."""
    held, n = [], 0
    for t in tables:
        held.append(t)
        n += t.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()
