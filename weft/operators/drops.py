"""Steepest drops in descending lists, and the blocks they part a list into.

Plain Python over one list: the lists are the similarities of one equivalence
class to the others that share a column with it.
"""

from __future__ import annotations

from collections.abc import Sequence


def steepest_drop(values: Sequence[float], start: int = 0, least: float = 0.0, full: bool = True, ignore_last: bool = False) -> tuple[int, float, bool]:
    """(index after the block, size of the drop, whether the rest is taken whole).

    values descend.  The first value must exceed least, else the index is 0.
    full: when the rest spreads by less than its last value, it is one block.
    ignore_last: the fall from the last value to nothing does not count.
    """
    n = len(values)
    if start >= n or not values[0] > least:
        return 0, 0.0, False
    if start == n - 1:
        return n, 0.0, True
    last = values[-1]
    if full and values[start] - last < last:
        return n, values[start] - last, True
    at, drop = n, 0.0
    for i in range(start, n - 1):
        if values[i] - values[i + 1] > drop:
            at, drop = i + 1, values[i] - values[i + 1]
    if not ignore_last and last > drop:
        return n, last, at == n
    return at, drop, False


def signature_blocks(values: Sequence[float], least: float = 0.0, full: bool = True, ignore_last: bool = False, ignore_minor: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the blocks of a descending list.

    ignore_minor: once there is a block, a drop smaller than the spread of the
    block before it ends nothing; all that is left becomes the last block.
    """
    blocks: list[tuple[int, int]] = []
    start, n = 0, len(values)
    while start < n:
        end, drop, whole = steepest_drop(values, start, least, full, ignore_last)
        if end <= start:
            break
        if not whole and ignore_minor and blocks and values[start] - values[end - 1] > drop:
            end = n
        blocks.append((start, end))
        start = end
    return blocks


def kept_blocks(sizes: Sequence[int], how: str) -> int:
    """How many of the first blocks a robust signature keeps, from their numbers of terms.

    LIBERAL: those before the first largest; IGNORE-LAST: all but the last; at least one each.
    """
    if not sizes:
        return 0
    if how == "LIBERAL":
        return max(1, list(sizes).index(max(sizes)))
    if how == "IGNORE-LAST":
        return max(1, len(sizes) - 1)
    raise ValueError(f"no robustifier: {how!r}")


def common_column_blocks(node: set, blocks: Sequence[Sequence[set]], least: int = 0) -> int:
    """How many first blocks have a column in common with the node throughout (sets of columns of the members)."""
    kept = 0
    for members in blocks:
        columns = set(node)
        for m in members:
            columns &= m
        if not columns:
            break
        kept += 1
    return max(least, kept)
