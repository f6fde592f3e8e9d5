"""Shares of a multi-index table dealt to tasks, hot ones to several.

A row belongs to the share that its substring's leading bits name, and is looked up in
the shares within a few bits of that.  A share that many rows belong to (a group of near
copies that differ a little, say) is cut by a hash of the row into s parts, and each part
of its rows meets each part of those looked up in it in a cell of its own: s * s tasks,
no pair met twice, none left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Roles of a row in a cell.
BOTH, HELD, ASKING = 0, 1, 2


def counted(tops: list[np.ndarray], bits: int) -> np.ndarray:
    """Rows that belong to each share of each table."""
    return np.stack([np.bincount(t.astype(np.int64), minlength=1 << bits) for t in tops])


def parts_of(counts: np.ndarray, most: int) -> np.ndarray:
    """Parts of each share, of about `most` rows."""
    return np.maximum(1, -(-counts // most)).astype(np.int32)


def dealt(share: np.ndarray, belongs: bool, key: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, cell of each, role) of rows that are sent to shares of one table; parts: of each share of it; key: ascending numbers or hashes of the rows."""
    s = parts[share].astype(np.int64)
    single = np.flatnonzero(s == 1)
    if len(single):
        yield single, np.zeros(len(single), np.int64), BOTH if belongs else ASKING
    rows = np.flatnonzero(s > 1)
    if not len(rows):
        return
    s = s[rows]
    mine = (key[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % s
    for k in range(int(s.max())):
        some = s > k
        yield rows[some], k * s[some] + mine[some], ASKING
        if belongs:
            yield rows[some], mine[some] * s[some] + k, HELD
