"""Burrows-Wheeler transforms of shards, and their merge by iterative interleave refinement."""

from __future__ import annotations

import numpy as np


def stable_order(key: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers below 2 ** 32, by 16-bit digits (numpy sorts those by radix)."""
    low = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    if int(key.max(initial=0)) < 1 << 16:
        return low
    return low[np.argsort((key >> 16).astype(np.uint16)[low], kind="stable")]


def shard_bwt(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rotations of data by their first `depth` bytes or more, the byte before each: the transform)."""
    n = len(data)
    around = np.concatenate([data, data[: 8 % n], np.resize(data, 8)])[: n + 8] if n >= 8 else np.resize(data, n + 8)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | around[k : k + n].astype(np.uint64)
    width = 8
    order = np.argsort(rank, kind="stable")
    while True:
        s = rank[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])).astype(np.uint64)
        if width >= depth or int(rank[order[-1]]) == n - 1:
            return order, data[order - 1]
        rank = rank * np.uint64(n + 1) + np.roll(rank, -(width % n))
        order = np.argsort(rank, kind="stable")
        width *= 2


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the transforms of circular shards to the given depth, without comparing or re-sorting suffixes.

    Returns (place, block): the suffixes' places in the concatenated shards in merged order, and for each a number that two
    share exactly if their first `depth` bytes are equal, so that neighbours in a block have that much common prefix.

    The interleave of the shards' orders is refined as in the merge of Holt and McMillan: if it is right for the first d
    bytes, walking it and putting each suffix's predecessor into the next free slot of the predecessor's block makes it
    right for d more. The predecessor comes from the transforms alone (last-to-first mapping). A step there takes one
    symbol; as mappings compose, each step here takes as many symbols as are settled, so that log2(depth) steps suffice.
    """
    places, symbols, back, base = [], [], [], 0
    for data in shards:
        order, before = shard_bwt(data, depth)
        places.append(order + base)
        symbols.append(before)
        to = np.empty(len(data), np.int64)
        to[np.argsort(before, kind="stable")] = np.arange(len(data))  # the i-th of a symbol in the transform starts the i-th rotation
        back.append(to + base)
        base += len(data)
    if not base:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, mapped, first = np.concatenate(places), np.concatenate(back), np.empty(base, np.uint8)
    first[mapped] = np.concatenate(symbols)  # a rotation's first byte is the last one of what it was mapped from

    def blocks(bound: np.ndarray, walk: np.ndarray) -> np.ndarray:
        block = np.empty(base, np.int64)
        block[walk] = np.cumsum(bound)
        return block

    walk = np.argsort(first, kind="stable")  # the interleave, right for one byte: shards keep their own order in a block
    bound = np.concatenate([[False], first[walk][1:] != first[walk][:-1]])
    block, settled, powers = blocks(bound, walk), 1, {1: mapped}
    while settled < depth:
        step = min(settled, depth - settled)
        if step not in powers:
            hop, rest, at = None, step, 1
            while rest:  # compose the mapping `step` times
                if at not in powers:
                    powers[at] = powers[at // 2][powers[at // 2]]
                if rest & 1:
                    hop = powers[at] if hop is None else powers[at][hop]
                rest >>= 1
                at *= 2
            powers[step] = hop
        before = powers[step][walk]
        key = block[before]
        slot = stable_order(key)
        then = before[slot]
        key, came = key[slot], block[walk][slot]
        bound = np.concatenate([[False], (key[1:] != key[:-1]) | (came[1:] != came[:-1])])
        walk, settled = then, settled + step
        block = blocks(bound, walk)
    return place[walk], block[walk]
