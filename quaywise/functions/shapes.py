"""Planar relations of two shapes as array arithmetic: an area is its closed ring of corners, a line an open chain of
two corners or more, a point a chain of one.

These run inside Arrow batches on the few pairs whose bounds meet; bounds are compared in Spark before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _edges(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (r, r) if len(r) == 1 else (r[:-1], r[1:])


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))


def _between(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((p >= np.minimum(a, b)) & (p <= np.maximum(a, b))).all(-1)


def is_area(r: np.ndarray) -> bool:
    return len(r) > 3 and bool((r[0] == r[-1]).all())


def is_line(r: np.ndarray) -> bool:
    return len(r) > 1 and not is_area(r)


def on_border(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    a, b = _edges(ring)
    p = points[:, None, :]
    return ((_turn(a[None], b[None], p) == 0) & _between(a[None], b[None], p)).any(1)


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Strictly inside, by crossings of a ray to the right."""
    if not is_area(ring):
        return np.zeros(len(points), bool)
    a, b = _edges(ring)
    x, y = points[:, None, 0], points[:, None, 1]
    rise = b[:, 1] - a[:, 1]
    at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / np.where(rise == 0, 1.0, rise) + a[:, 0]
    crossed = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < at)
    return (crossed.sum(1) % 2 == 1) & ~on_border(points, ring)


def _crossings(r: np.ndarray, s: np.ndarray) -> bool:
    """Some edge of one goes right through an edge of the other."""
    a, b = (e[:, None, :] for e in _edges(r))
    c, d = (e[None, :, :] for e in _edges(s))
    return bool(((_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)).any())


def _reach(r: np.ndarray) -> np.ndarray:
    a, b = _edges(r)
    return np.concatenate([r, (a + b) / 2])


def _corners(r: np.ndarray) -> np.ndarray:
    """The corners at which a shape turns: of an area from its smallest one on, to the smaller of the two next to it;
    of a line from its smaller end."""
    closed = is_area(r)
    p = r[:-1] if closed else r
    p = p[np.append(True, (p[1:] != p[:-1]).any(1))]
    if closed:
        p = p[_turn(np.roll(p, 1, 0), p, np.roll(p, -1, 0)) != 0]
        p = np.roll(p, -int(np.lexsort((p[:, 1], p[:, 0]))[0]), 0) if len(p) else p
        turned = np.roll(p[::-1], 1, 0)
    else:
        if len(p) > 2:
            p = p[np.concatenate([[True], _turn(p[:-2], p[1:-1], p[2:]) != 0, [True]])]
        turned = p[::-1]
    return min(p, turned, key=lambda x: x.ravel().tolist())


def equals(r: np.ndarray, s: np.ndarray) -> bool:
    """The same points: the same corners in the same order, from any start and in either direction; corners on a
    straight stretch do not count."""
    if is_area(r) != is_area(s):
        return False
    a, b = _corners(r), _corners(s)
    return a.shape == b.shape and bool((a == b).all())


def intersects(r: np.ndarray, s: np.ndarray) -> bool:
    return bool(_crossings(r, s) or on_border(r, s).any() or on_border(s, r).any() or inside(r[:1], s)[0] or inside(s[:1], r)[0])


def disjoint(r: np.ndarray, s: np.ndarray) -> bool:
    return not intersects(r, s)


def interiors_meet(r: np.ndarray, s: np.ndarray) -> bool:
    if not (is_area(r) or is_area(s)):
        return bool(_crossings(r, s) or equals(r, s))
    return bool(_crossings(r, s) or inside(_reach(r), s).any() or inside(_reach(s), r).any() or equals(r, s))


def contains(r: np.ndarray, s: np.ndarray) -> bool:
    """No point of ``s`` lies outside ``r``, and some point of it inside."""
    if not is_area(r):
        if len(r) == 1 or is_area(s):
            return len(r) == len(s) == 1 and equals(r, s)
        covered = on_border(_reach(s), r).all() and not _crossings(r, s)
        return bool(covered and (len(s) > 1 or not (s[0] == r[[0, -1]]).all(1).any()))  # ends alone are border
    p = _reach(s)
    covered = (inside(p, r) | on_border(p, r)).all() and not _crossings(r, s)
    if is_area(s):
        return bool(covered and not inside(r, s).any() and interiors_meet(r, s))
    return bool(covered and inside(p, r).any())


def within(r: np.ndarray, s: np.ndarray) -> bool:
    return contains(s, r)


def touches(r: np.ndarray, s: np.ndarray) -> bool:
    """They meet, but only with their borders."""
    if len(r) == 1 and len(s) == 1:
        return False
    if len(r) == 1 or len(s) == 1:
        return bool(on_border(r, s).any() if len(r) == 1 else on_border(s, r).any())
    return intersects(r, s) and not interiors_meet(r, s)


def overlaps(r: np.ndarray, s: np.ndarray) -> bool:
    """Two areas share inner points, and neither contains the other."""
    return is_area(r) and is_area(s) and interiors_meet(r, s) and not contains(r, s) and not contains(s, r)


def crosses(r: np.ndarray, s: np.ndarray) -> bool:
    """Two lines go through each other, or a line is partly inside an area and partly outside it."""
    if is_line(r) and is_line(s):
        return _crossings(r, s)
    if not (is_line(r) and is_area(s) or is_area(r) and is_line(s)):
        return False
    line, area = (r, s) if is_line(r) else (s, r)
    p = _reach(line)
    inner, border = inside(p, area), on_border(p, area)
    return bool(_crossings(line, area) or inner.any() and (~inner & ~border).any())


#: Relations by the name an intent gives them; each is ``f(stored ring, query ring)``.
RELATIONS: dict[str, Callable[[np.ndarray, np.ndarray], bool]] = {f"s_{f.__name__}": f for f in (intersects, contains, within, disjoint, overlaps, crosses, touches, equals)}
