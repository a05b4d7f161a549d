"""Row numbers in groups of any size: no group is ever brought into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.plans.lineage import shuffle_width, written


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the row before; nulls equal nulls."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False).astype(bool)


def _count(group: list[str], name: str, previous: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, key, last = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            goes_on = tuple(batch[c][0].as_py() for c in group) == key
            new = np.concatenate([[not goes_on], np.logical_or.reduce([_differs(batch[c]) for c in group])])
            starts = np.unique(np.concatenate([[0], np.flatnonzero(new)]))
            number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
            if goes_on:
                number[: starts[1] if len(starts) > 1 else n] += before
            mine = []
            for c in previous:
                shifted = pa.concat_arrays([last.get(c, pa.nulls(1, batch[c].type)), batch[c].slice(0, n - 1)])
                mine.append(pc.if_else(pa.array(new), pa.scalar(None, batch[c].type), shifted))
                last[c] = batch[c].slice(n - 1)
            before, key = int(number[-1]), tuple(batch[c][n - 1].as_py() for c in group)
            added = [*mine, pa.array(number), pa.array(np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added],
                names=[*batch.schema.names, *(f"previous_{c}" for c in previous), name, "__part"],
            )

    return run


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, previous: tuple[str, ...] = ()) -> DataFrame:
    """rows with `name`: 1, 2, ... in each group by `order`, and previous_c, the value of c in the row before, for each c of `previous`.

    Rows are range-partitioned by group and order, so a large group spreads over as many partitions as it fills, and are
    counted there; a partition's rows of a group then start behind those of the partitions before. Only groups that reach
    over a border have such offsets: one for each partition at most, which is what is broadcast."""
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), *group, *order).sortWithinPartitions(*group, *order)
    added = [StructField(f"previous_{c}", rows.schema[c].dataType) for c in previous]
    schema = StructType([*rows.schema.fields, *added, StructField(name, LongType()), StructField("__part", IntegerType())])
    counted = written(ordered.mapInArrow(_count(group, name, list(previous)), schema), "numbered")
    final = F.max_by(F.struct(F.lit(1).alias("one"), *(F.col(c).alias(f"__last_{c}") for c in previous)), name)
    sizes = counted.groupBy(*group, "__part").agg(F.max(name).alias("__n"), final.alias("__final"))
    per = Window.partitionBy(*group).orderBy("__part")
    before = F.sum("__n").over(per.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__before", before).withColumn("__final", F.lag("__final").over(per)).where("__before > 0")
    offsets = offsets.select(*(F.col(c).alias(f"__{c}") for c in (*group, "__part")), "__before", "__final")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, "__part")]
    out = counted.join(F.broadcast(offsets), same, "left")
    earlier = [F.when(F.col(name) == 1, F.col(f"__final.__last_{c}")).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}") for c in previous]
    return out.select(*rows.columns, *earlier, (F.col(name) + F.coalesce("__before", F.lit(0))).alias(name))
