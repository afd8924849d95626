"""Catalog search, facets, existence flags, unique slugs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import first_non_empty, slugify


def catalog_view(refs: DataFrame) -> DataFrame:
    """Catalog rows from references with a ``custom`` map; title falls back to the key."""
    c = F.col("custom")
    return refs.select("key", first_non_empty(c["title"], F.col("key")).alias("title"), *[F.coalesce(c[k], F.lit("")).alias(k) for k in ("genre", "year", "description")], "size", "content_type", "created_at", "updated_at")


def search(catalog: DataFrame, *, genre: str = "", query: str = "") -> DataFrame:
    """Case-insensitive genre equality and substring match over title, genre and description, by title."""
    out = catalog
    if genre:
        out = out.where(F.lower("genre") == genre.lower())
    if query:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "genre", "description")), F.lit(query.lower())))
    return out.orderBy(F.lower("title"), "key")


def facets(catalog: DataFrame, column: str = "genre") -> DataFrame:
    """Distinct non-empty values in order; taken before any filter applies."""
    return catalog.where(F.col(column) != "").select(column).distinct().orderBy(column)


def with_flag(rows: DataFrame, others: DataFrame, on: str, flag: str) -> DataFrame:
    """Existence flag: whether ``others`` has the row's key. Repeated keys there don't multiply rows."""
    return rows.join(others.select(on).distinct().withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


_NUMBERED = re.compile(r"(.+)-([1-9][0-9]*)")


def unique_slugs(rows: DataFrame, title: str, order: str, default: str = "movie") -> DataFrame:
    """Slugs that no two rows share: each row, in ``order``, takes the first free of base, base-2, base-3 ...

    A name may be taken by another title ("a 2" and the second "a" both want a-2), so rows whose
    slugs differ only in numbers at their end are named together: they stream through one sorted
    partition, with a counter a slug as the only state. One hot title needs time but no memory.
    Rows that tie in ``order`` are taken by title.
    """
    made = rows.withColumn("__slug", slugify(title, default)).withColumn("__root", F.regexp_replace("__slug", "(-[0-9]+)+$", ""))
    made = made.repartition("__root").sortWithinPartitions("__root", order, title)
    out, kept = T.StructType([*rows.schema.fields, T.StructField("slug", T.StringType())]), list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        plain: set[str] = set()
        free: dict[str, int] = {}  # the least number a slug hasn't given out
        for b in batches:
            names = []
            for root, slug in zip(b.column("__root").to_pylist(), b.column("__slug").to_pylist()):
                if root != now:
                    now, plain, free = root, set(), {}
                at = _NUMBERED.fullmatch(slug)
                if slug not in plain and not (at and int(at[2]) > 1 and free.get(at[1], 2) > int(at[2])):
                    plain.add(slug)
                    names.append(slug)
                    continue
                k = free.get(slug, 2)
                while f"{slug}-{k}" in plain:
                    k += 1
                free[slug] = k + 1
                names.append(f"{slug}-{k}")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(names, pa.string())], names=out.names)

    return made.mapInArrow(run, out)


def attach(rows: DataFrame, parents: DataFrame, *, parent: str = "parent", size: str = "size", most: int = 20 << 20) -> DataFrame:
    """Objects that hang on another one (a poster on a film), with reason: null where accepted, else
    ``parent not found`` or ``too large`` (over ``most`` bytes). ``parents`` has key."""
    known = parents.select(F.col("key").alias(parent)).distinct().withColumn("__known", F.lit(True))
    reason = F.when(F.col("__known").isNull(), "parent not found").when(F.col(size) > most, "too large")
    return rows.join(known, parent, "left").withColumn("reason", reason).drop("__known").select(*rows.columns, "reason")


def cascade(keys: DataFrame, attached: DataFrame, *, parent: str = "parent") -> DataFrame:
    """The keys to delete with ``keys``: themselves and what hangs on them."""
    return keys.select("key").unionByName(attached.join(keys.select(F.col("key").alias(parent)), parent, "left_semi").select("key")).distinct()


def free_name(existing: DataFrame, base: str, pattern: str = "{base} ({n})", column: str = "key") -> str:
    """``base``, or the first numbered variant that no row has.

    Of n rows that could clash at most n numbers are taken, so the free one is among n + 1.
    """
    like = existing.where(F.startswith(F.col(column), F.lit(base))).select(column).distinct()
    if not like.where(F.col(column) == base).limit(1).count():
        return base
    taken = like.count()
    numbers = existing.sparkSession.range(1, taken + 2).select("id", F.concat(*[F.lit(base) if p == "base" else F.col("id").cast("string") if p == "n" else F.lit(p) for p in _split(pattern)]).alias(column))
    return numbers.join(like, column, "left_anti").agg(F.min_by(column, "id")).first()[0]


def _split(pattern: str) -> list[str]:
    import string

    return [x for text, name, _, _ in string.Formatter().parse(pattern) for x in (text, name) if x]
