"""Evidence from glyph masks: boolean images of the pixels that letters cover, one at a time or as a stack of equal ones."""

from __future__ import annotations

import unicodedata

import numpy as np

# Pixels and shares that results depend on.
LEAST_UNION = 20
LIGHT, DARK, OUTLINE_PX = 210, 90, 3
GLYPH_AREA, GLYPH_HEIGHT, GLYPH_WIDTH, MASK_WIDTH = (2, 650), 35, 50, 522
REGION_MOVE, REGION_LEAST, REGION_COMMON, REGION_UNION = (0.055, 0.09, 0.055, 0.09), 65, 0.985, 0.85


def _count(mask: np.ndarray) -> np.ndarray:
    return mask.sum(axis=(-2, -1), dtype=np.int64)


def _boxed(image: np.ndarray, radius: int) -> np.ndarray:
    """How many pixels are set in the square around each pixel, by running sums."""
    h, w = image.shape
    total = np.pad(image.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    top, bottom = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    left, right = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    return total[bottom][:, right] - total[bottom][:, left] - total[top][:, right] + total[top][:, left]


def _islands(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the set pixels and, for each, the least number of those that it is joined to, corners included."""
    number = np.full(image.size, -1)
    at = np.flatnonzero(image)
    number[at] = np.arange(len(at))
    number = number.reshape(image.shape)
    ends = []
    for here, there in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])):
        both = (number[here] >= 0) & (number[there] >= 0)
        ends.append(np.stack([number[here][both], number[there][both]]))
    a, b = np.concatenate(ends, axis=1)
    root = np.arange(len(at))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return at, root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def glyph_mask(gray: np.ndarray) -> np.ndarray:
    """The pixels of outlined light letters in a grey image: light ones near dark ones, in islands of a glyph's size."""
    h, w = gray.shape
    light = (gray > LIGHT) & (_boxed(gray < DARK, OUTLINE_PX) > 0)
    at, root = _islands(light)
    mask = np.zeros(gray.shape, bool)
    if not len(at):
        return mask
    y, x = np.divmod(at, w)
    _, island, area = np.unique(root, return_inverse=True, return_counts=True)
    spread = lambda v: np.maximum.reduceat(v[np.argsort(island, kind="stable")], np.r_[0, np.cumsum(area)[:-1]])
    height, width = spread(y) + spread(-y) + 1, spread(x) + spread(-x) + 1
    scale = max(1.0, w / MASK_WIDTH)
    fits = (area >= GLYPH_AREA[0]) & (area < GLYPH_AREA[1] * scale**2) & (height < GLYPH_HEIGHT * scale) & (width < GLYPH_WIDTH * scale)
    mask.ravel()[at[fits[island]]] = True
    return mask


def tiles(only: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels set in each tile; tiles at the edge may be smaller."""
    rows = np.add.reduceat(only.astype(np.int64), np.arange(0, only.shape[-2], height), axis=-2)
    return np.add.reduceat(rows, np.arange(0, only.shape[-1], width), axis=-1)


def _comparable(a: np.ndarray, b: np.ndarray) -> bool:
    return a.shape == b.shape and a.size > 0


def _most(only: np.ndarray, height: int, width: int) -> np.ndarray:
    return tiles(only, height, width).max(axis=(-2, -1))


def compatible(a: np.ndarray, b: np.ndarray):
    """Frames that one recognition may serve."""
    if not _comparable(a, b):
        return False
    union, only = _count(a | b), a ^ b
    return (union >= LEAST_UNION) & (_count(only) <= np.maximum(2, union * 0.035)) & (_most(only, 16, 16) <= 5)


def changed(a: np.ndarray, b: np.ndarray):
    """Frames whose text has surely changed, as a whole or in one place."""
    if a.shape != b.shape:
        return True
    if not a.size:
        return False
    only = a ^ b
    return (_count(only) > np.maximum(4, _count(a | b) * 0.08)) | (_most(only, 24, 48) > 18)


def similar(a: np.ndarray, b: np.ndarray):
    if not _comparable(a, b):
        return False
    union, only = _count(a | b), a ^ b
    return (union >= LEAST_UNION) & (_count(only) <= union * 0.045) & (_most(only, 16, 16) <= 5)


def similar_over_gap(a: np.ndarray, b: np.ndarray):
    """similar, or much text of which a little, in one or two places, differs more."""
    if not _comparable(a, b):
        return False
    union, only = _count(a | b), a ^ b
    per_tile = tiles(only, 16, 16)
    loose = (union >= 100) & (_count(only) <= union * 0.03) & (per_tile.max(axis=(-2, -1)) <= 12) & ((per_tile > 5).sum(axis=(-2, -1)) <= 2)
    return similar(a, b) | loose


def density(mask: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """The share of a box's pixels that are set; the box is x, y, width, height as shares of the mask."""
    h, w = mask.shape[-2:]
    x1, x2 = (min(w, max(0, round(v * w))) for v in (box[0], box[0] + box[2]))
    y1, y2 = (min(h, max(0, round(v * h))) for v in (box[1], box[1] + box[3]))
    return mask[..., y1:y2, x1:x2].mean(axis=(-2, -1)) if x2 > x1 and y2 > y1 else 0.0


def cut(mask: np.ndarray, bounds) -> np.ndarray:
    """The part of a mask within bounds (left, top, right, bottom, as shares)."""
    h, w = mask.shape
    left, top, right, bottom = bounds
    return mask[round(top * h) : round(bottom * h), round(left * w) : round(right * w)]


def same_layout(a: np.ndarray, b: np.ndarray, bounds) -> bool:
    """Masks of one text whose readings differ in spaces only: enough pixels in the reading's bounds, and none changed."""
    if a.shape != b.shape:
        return False
    h, w = a.shape
    left, right = max(0, int(bounds[0] * w) - 2), min(w, int(bounds[2] * w) + 3)
    top, bottom = max(0, int(bounds[1] * h) - 2), min(h, int(bounds[3] * h) + 3)
    a, b = a[top:bottom, left:right], b[top:bottom, left:right]
    return min(int(a.sum()), int(b.sum())) >= 40 and not changed(a, b)


def _advance(text: str) -> np.ndarray:
    """How far each character moves the pen, in widths of a full one."""
    kinds = [(bool(unicodedata.combining(c)), c.isspace(), unicodedata.east_asian_width(c) in "WF") for c in text]
    return np.array([0.0 if mark else 0.42 if space else 1.0 if wide else 0.62 for mark, space, wide in kinds])


def glyph_region_match(first: np.ndarray, second: np.ndarray, box, other, text: str, span: tuple[int, int]) -> bool:
    """Whether the pixels of one disputed glyph, the span of a line's text, are the same in two masks; box and other are the
    line's x, y, width and height in each."""
    moved = np.abs(np.subtract(box, other))
    pen = np.r_[0.0, _advance(text).cumsum()]
    if first.shape != second.shape or (moved >= REGION_MOVE).any() or not pen[-1]:
        return False
    h, w = first.shape
    corners = np.array([[b[0], b[1], b[0] + b[2], b[1] + b[3]] for b in (box, other)])
    (left, top), (right, bottom) = corners[:, :2].min(axis=0), corners[:, 2:].max(axis=0)
    # A character's mean width on either side is taken along: narrow letters are not where even spacing puts them.
    margin = max(1.0, pen[-1] / len(text))
    low, high = max(0.0, (pen[span[0]] - margin) / pen[-1]), min(1.0, (pen[span[1]] + margin) / pen[-1])
    x1, x2 = max(0, round((left + (right - left) * low) * w)), min(w, round((left + (right - left) * high) * w))
    y1, y2 = max(0, round((top - 0.015) * h)), min(h, round((bottom + 0.015) * h))
    if x2 - x1 < 12 or y2 - y1 < 8:
        return False
    a, b = first[y1:y2, x1:x2], second[y1:y2, x1:x2]
    both, least, union = int((a & b).sum()), min(int(a.sum()), int(b.sum())), int((a | b).sum())
    return least >= REGION_LEAST and both >= REGION_COMMON * least and both >= REGION_UNION * union
