"""Quotas: a token bucket per tenant and dimension."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def token_bucket(requests: DataFrame, key: Sequence[str], at: str, cost: str, capacity: float, per_second: float, tie: Sequence[str] = ()) -> DataFrame:
    """Each request with ``admitted`` and ``tokens``, what the bucket holds after it.

    A bucket starts full; before a request it holds min(capacity, tokens + per_second * elapsed); the request is admitted, and its cost taken, if the bucket
    holds as much. ``at`` is in microseconds. A null cost counts as 0, a null time as no time passed; requests are taken in the order of at and ``tie``.

    Whether a request is admitted depends on all before it, so a bucket is one task's; it is streamed in order with one number of state, never
    held. Buckets are spread by key, so give the dimension its own key column where a tenant has several.
    """
    cols = requests.columns
    ordered = requests.repartition(*key).sortWithinPartitions(*key, at, *tie)

    def admit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, before = None, 0.0, None
        for b in batches:
            admitted, left = [], []
            for *k, t, c in zip(*[b.column(x).to_pylist() for x in (*key, at, cost)], strict=True):
                if k != now:
                    now, tokens, before = k, capacity, t
                if t is not None and before is not None and t > before:
                    tokens = min(capacity, tokens + per_second * (t - before) / 1_000_000)
                before = t if t is not None else before
                ok = tokens >= (c or 0)
                tokens -= (c or 0) if ok else 0
                admitted.append(ok)
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in cols], pa.array(admitted, pa.bool_()), pa.array(left, pa.float64())], names=[*cols, "admitted", "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", admitted boolean, tokens double"
    return ordered.mapInArrow(admit, schema)
