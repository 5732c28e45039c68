"""Placement and availability arithmetic as columns."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Virtual nodes of each node on the ring.
VNODES = 150


def hash_key(key: Column) -> Column:
    """First four bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def ring(nodes: Sequence[str], vnodes: int = VNODES) -> list[tuple[int, str]]:
    """(position, node), sorted; the size is nodes * vnodes."""
    return sorted((int(hashlib.sha256(f"{n}#{i}".encode()).hexdigest()[:8], 16), n) for n in nodes for i in range(vnodes))


def _before(key: Column, points: list[tuple[int, str]]) -> Column:
    """How many positions are under the key's hash, which is computed once: a coarse ring first, then one stretch of the whole."""
    step = max(1, math.isqrt(len(points)))
    numbers = lambda own: F.expr(f"array({', '.join(f'{p}L' for p, _ in own)})")
    at, coarse = numbers(points), numbers(points[::step])

    def index(h: Column) -> Column:
        skipped = F.greatest(F.size(F.filter(coarse, lambda p: p < h)) - 1, F.lit(0)) * step
        return F.transform(F.array(skipped), lambda s: s + F.size(F.filter(F.slice(at, s + 1, F.lit(step)), lambda p: p < h)))[0]

    return F.transform(F.array(hash_key(key)), index)[0]


def _at(names: Sequence[str], index: Column) -> Column:
    """The name at an index that wraps round."""
    different = sorted(set(names))
    which = F.expr(f"array({', '.join(str(different.index(n) + 1) for n in names)})")
    return F.element_at(F.array(*(F.lit(n) for n in different)), F.element_at(which, index % len(names) + 1))


def ring_node(key: Column, nodes: Sequence[str], vnodes: int = VNODES) -> Column:
    """The node at the first position not under the key's hash, wrapping round; null on an empty ring.

    The ring is a literal array, searched in the projection: no join, no shuffle.
    """
    points = ring(nodes, vnodes)
    if not points:
        return F.lit(None).cast("string")
    return _at([n for _, n in points], _before(key, points))


def ring_nodes(key: Column, nodes: Sequence[str], n: int, vnodes: int = VNODES) -> Column:
    """The first n distinct nodes clockwise from the key."""
    points = ring(nodes, vnodes)
    if not points:
        return F.array().cast("array<string>")
    # What follows each position is known beforehand.
    names = [name for _, name in points]
    after = [list(dict.fromkeys(names[i:] + names[:i]))[:n] for i in range(len(points))]
    kinds = sorted(set(map(tuple, after)))
    orders = F.array(*(F.array(*(F.lit(x) for x in own)) for own in kinds))
    return F.element_at(orders, F.element_at(F.expr(f"array({', '.join(str(kinds.index(tuple(own)) + 1) for own in after)})"), _before(key, points) % len(points) + 1))


def rendezvous(key: Column, nodes: Sequence[str], n: int = 1) -> Column:
    """The n nodes of the highest SHA-256(node, 0, key), best first; ties to the larger name."""
    weights = [F.struct(F.substring(F.sha2(F.concat(F.lit(x), F.lit("\0"), key).cast("binary"), 256), 1, 16).alias("w"), F.lit(x).alias("node")) for x in nodes]
    if not weights:
        return F.array().cast("array<string>")
    return F.slice(F.transform(F.reverse(F.array_sort(F.array(*weights))), lambda s: s["node"]), 1, n)


def acks(level: Column, replicas: Column) -> Column:
    """Answers that a consistency level needs: one 1, quorum n / 2 + 1, all n; n under 1 counts as 1."""
    n = F.greatest(replicas, F.lit(1))
    return F.when(level == "all", n).when(level == "quorum", F.floor(n / 2) + 1).otherwise(F.lit(1)).cast("long")


def health(elapsed: Column, suspect: float = 5.0, dead: float = 15.0) -> Column:
    """State after so many seconds without a sign of life."""
    return F.when(elapsed >= dead, "dead").when(elapsed >= suspect, "suspect").otherwise("alive")


def migration_batches(n: Column, size: int = 1000) -> Column:
    return F.ceil(n / size).cast("long")
