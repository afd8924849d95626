"""Sequential quota admission."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def admit(requests: DataFrame, limits: DataFrame, *, order: str, ns: str = "ns", size: str = "size") -> DataFrame:
    """``requests`` with reason: null where admitted, else the first limit it would break.

    Requests of a namespace are taken in ``order``; a rejected one leaves the usage as it was, so a
    running total can't express it. The checks are blob_count (count >= limit), bytes (total > limit)
    and blob_size (size > limit), where 0 or null is unlimited. Rows stream through sorted
    partitions with the usage as the only state, so one large namespace needs time but no memory.
    They are partitioned by a hash of the namespace: a repartition by the join's own key would be
    planned away, and the join's partitions may be read in pieces once it has become a broadcast.

    ``limits``: ns, max_blob_count, max_bytes, max_blob_size, and optionally used_count and used_bytes.
    """
    names = ["max_blob_count", "max_bytes", "max_blob_size", "used_count", "used_bytes"]
    known = limits.select(ns, *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(f"__{c}") if c in limits.columns else F.lit(0).cast("long").alias(f"__{c}") for c in names])
    rows = requests.join(known, ns, "left").repartition(F.xxhash64(ns)).sortWithinPartitions(ns, order)
    keep = list(requests.columns)
    out = T.StructType([*requests.schema.fields, T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, used = object(), 0, 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (ns, size, *(f"__{c}" for c in names))]
            reasons = []
            for name, n, most, total, largest, had, held in zip(*cols):
                if name != now:
                    now, count, used = name, had or 0, held or 0
                n = n or 0
                if most and count >= most:
                    reasons.append("blob_count")
                elif total and used + n > total:
                    reasons.append("bytes")
                elif largest and n > largest:
                    reasons.append("blob_size")
                else:
                    reasons.append(None)
                    count, used = count + 1, used + n
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(reasons, pa.string())], names=out.names)

    return rows.mapInArrow(run, out)
