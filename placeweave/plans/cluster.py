"""Days as clusters of stops: projection, k-means, capacity repair, medoids. Plain numpy, for one request's pool."""

from __future__ import annotations

import math

import numpy as np

from placeweave import config as C


def project(points: list[dict], origin: tuple[float, float] | None = None) -> np.ndarray:
    """Metres east and north of the mean point, or of an origin."""
    if not points:
        return np.empty((0, 2))
    at = np.array([(p["lat"], p["lng"]) for p in points])
    lat0, lng0 = origin or at.mean(axis=0)
    return np.radians(at[:, ::-1] - (lng0, lat0)) * C.EARTH_RADIUS_M * (math.cos(math.radians(lat0)), 1.0)


def k_means(x: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of several Lloyd runs from spread seeds; the same for the same input."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        centres = [x[rng.integers(len(x))]]
        for _ in range(k - 1):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        centres = np.array(centres)
        for _ in range(100):
            labels = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        inertia = ((x - centres[labels]) ** 2).sum()
        if best is None or inertia < best[0]:
            best = (inertia, labels, centres)
    return best[1], best[2]


def by_day(points: list[dict], days: int, capacity: int) -> list[list[dict]]:
    """points(lat, lng, rank_score) in `days` groups of at most `capacity`, each by falling score; one day keeps only the best."""
    score = lambda p: -p["rank_score"]
    if days <= 0:
        return []
    if not points:
        return [[] for _ in range(days)]
    if days == 1:
        return [sorted(points, key=score)[:capacity]]
    if len(points) <= days:
        return [[p] for p in points] + [[] for _ in range(days - len(points))]
    x = project(points)
    labels, centres = k_means(x, days)
    groups = [[i for i in range(len(points)) if labels[i] == d] for d in range(days)]
    away = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
    for _ in range(2 * len(points)):
        over = [d for d in range(days) if len(groups[d]) > capacity]
        room = [d for d in range(days) if len(groups[d]) < capacity]
        if not over or not room:
            break
        full = max(over, key=lambda d: len(groups[d]))
        # the point that loses least by leaving goes to the nearest group with room
        moved = max(groups[full], key=lambda i: away[i, full] - min(away[i, d] for d in room))
        groups[full].remove(moved)
        groups[min(room, key=lambda d: away[moved, d])].append(moved)
    return [sorted((points[i] for i in g), key=score) for g in groups]


def medoid(points: list[dict]) -> dict | None:
    """The point with the least distance to all others; of one or two the better one."""
    if len(points) <= 2:
        return max(points, key=lambda p: p["rank_score"], default=None)
    x = project(points)
    return points[int(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1).argmin())]
