"""Blocks of consecutive ids, and values that meet across blocks.

Texts are dealt to blocks of consecutive ids. Blocks exchange sorted lists of
64-bit values, one list for each range of values: a value that is frequent in a
block travels once, and lists of one range meet in one task.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import pack, unpack

LISTS = "part int, block int, packed binary"


FINE = 1024


def _behind(id_col: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds a row's id is above; a null id is above none.

    Looked up in two steps, in the first bounds of stretches and then in a stretch.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    stretches = [bounds[k : k + step] for k in range(0, len(bounds), step)]

    def constant(value: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def above(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda e: F.coalesce(F.col(id_col) > e, F.lit(False))))

    stretch = above(constant([s[0] for s in stretches], "array<bigint>"))
    inside = F.get(constant(stretches, "array<array<bigint>>"), stretch - 1)
    return F.when(stretch == 0, F.lit(0)).otherwise((stretch - 1) * step + above(inside)).cast("int")


def _quantiles(docs: DataFrame, id_col: str, n: int) -> list[int]:
    at = [i / n for i in range(1, n)]
    if not at:
        return []
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), at, max(10_000, 8 * n))).first()[0]
    return sorted(set(found or []))


def cuts(sizes: dict[int, int], blocks: int) -> list[int]:
    """After which bins a block ends, so that `blocks` blocks of consecutive bins are about equally large."""
    total, held, out = sum(sizes.values()), 0, []
    for k in sorted(sizes):
        if held and (held + sizes[k] / 2) * blocks >= (len(out) + 1) * total:
            out.append(k - 1)
        held += sizes[k]
    return out


def block_of(docs: DataFrame, id_col: str, text_col: str, least: int, most_bytes: int) -> tuple[Column, int]:
    """The block of a row's id, ascending, and how many blocks there are.

    At least `least` blocks, and more where the texts are larger than `most_bytes` a
    block. Bytes are summed in fine bins between quantiles of the ids, of which there
    are a fixed number in each block's share; blocks are runs of bins of about equal
    bytes. Null ids are in the first block. Rows of one id lie in one block, whatever their bytes.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    blocks = max(least, -(-total // most_bytes))
    fine = _quantiles(docs, id_col, max(FINE, 4 * blocks) if blocks > 1 else 1)
    if not fine:
        return F.lit(0), 1
    rows = docs.groupBy(_behind(id_col, fine).alias("bin")).agg(F.sum(size).alias("n")).collect()
    ends = cuts({r["bin"]: r["n"] for r in rows}, blocks)
    bounds = sorted({fine[min(max(k, 0), len(fine) - 1)] for k in ends})
    return _behind(id_col, bounds), len(bounds) + 1


def spread(block: int, values: np.ndarray, parts: int) -> pd.DataFrame:
    """Sorted distinct values of a block as one row for each range of values that it has."""
    width = np.uint64((1 << 64) // parts + 1)
    cuts = np.searchsorted(values, np.arange(1, parts, dtype=np.uint64) * width)
    lists = [(k, block, pack(x)) for k, x in enumerate(np.split(values, cuts)) if len(x)]
    return pd.DataFrame(lists, columns=["part", "block", "packed"]).astype({"part": "int32", "block": "int32"})


def gather(packed) -> np.ndarray:
    """The values of several lists, sorted."""
    lists = [unpack(x) for x in packed if x is not None]
    return np.sort(np.concatenate(lists)) if lists else np.empty(0, np.uint64)


def shared(lists: DataFrame, *, spare_first: bool) -> DataFrame:
    """Of every list, the values that other blocks have too, for its own block.

    spare_first: the lowest block that has a value isn't told of it.
    """

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        values = [unpack(x) for x in frame["packed"]]
        owner = np.repeat(frame["block"].to_numpy(), [len(x) for x in values])
        value = np.concatenate(values)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        again = np.append(False, same)
        told = again if spare_first else again | np.append(same, False)
        value, owner = value[told], owner[told]
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
        ids, first = np.unique(owner, return_index=True)
        part = int(frame["part"].iloc[0])
        rows = [(part, int(b), pack(x)) for b, x in zip(ids, np.split(value, first[1:])) if len(x)]
        return pd.DataFrame(rows, columns=["part", "block", "packed"]).astype({"part": "int32", "block": "int32"})

    return lists.groupBy("part").applyInPandas(meet, LISTS)
