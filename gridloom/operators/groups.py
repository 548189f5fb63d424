"""Python functions over many small groups: the groups of a task come as one sorted stream, so a group costs no call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Row by row whether all columns agree; nulls agree with nulls."""
    out = np.ones(len(a), dtype=bool)
    for c in a.columns:
        x, y = a[c].to_numpy(dtype=object), b[c].to_numpy(dtype=object)
        out &= np.fromiter((p == q or (p != p or p is None) and (q != q or q is None) for p, q in zip(x, y, strict=True)), dtype=bool, count=len(x))
    return out


def _streamed(keys: list[str], run: Callable[[pd.DataFrame], list[tuple]], names: list[str], kinds: dict[str, str]):
    def put(groups: list[pd.DataFrame]) -> pd.DataFrame:
        rows = [(*(g[k].iloc[0] for k in keys), *r) for g in groups for r in run(g)]
        out = pd.DataFrame(rows, columns=[*keys, *names])
        return out.astype(kinds) if kinds else out

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # what came so far of the last group
        for frame in frames:
            if not len(frame):
                continue
            new = np.ones(len(frame), dtype=bool)
            new[1:] = ~_same(frame[keys].iloc[1:], frame[keys].iloc[:-1])
            if held:
                new[0] = not _same(frame[keys].iloc[:1], held[-1][keys].iloc[-1:])[0]
            starts = np.flatnonzero(new)
            if not len(starts):
                held.append(frame)
                continue
            done = []
            if held:
                done.append(pd.concat([*held, frame.iloc[: starts[0]]], ignore_index=True))
            done += [frame.iloc[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            held = [frame.iloc[starts[-1] :]]
            if done:
                yield put(done)
        if held:
            yield put([pd.concat(held, ignore_index=True)])

    return stream


def per_group(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], list[tuple]], fields: dict[str, str]) -> DataFrame:
    """The keys and fields (name -> type) of all rows that ``run`` gives for each group of rows with equal keys.

    Whole numbers of keys travel as text, so nulls among them don't make them inexact.
    """
    spark = df.sparkSession
    types = {k: df.schema[k].dataType.simpleString() for k in keys}
    whole = [k for k, t in types.items() if t in ("bigint", "int", "smallint", "tinyint")]
    text = df.withColumns({k: F.col(k).cast("string") for k in whole}) if whole else df
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = text.repartition(parts, *keys).sortWithinPartitions(*keys)
    scheme = ", ".join([*(f"`{k}` {'string' if k in whole else t}" for k, t in types.items()), *(f"`{n}` {t}" for n, t in fields.items())])
    pandas = {n: {"bigint": "int64", "long": "int64", "int": "int32", "double": "float64"}[t] for n, t in fields.items() if t in ("bigint", "long", "int", "double")}
    out = dealt.mapInPandas(_streamed(keys, run, list(fields), pandas), scheme)
    return out.select(*(F.col(k).cast(types[k]).alias(k) if k in whole else k for k in keys), *fields)
