"""Consolidation of each query's results: a group is cut to the result limit first, so one task holds one easily."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..markup.consolidate import Scored, consolidate

#: Fixed value: most results of a query.
MOST_RESULTS = 50


def checked_limit(k: int) -> int:
    """A result limit, which is from 1 to ``MOST_RESULTS``."""
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_RESULTS:
        raise ValidationError(f"the number of results is from 1 to {MOST_RESULTS}: {k}")
    return k


def consolidate_results(results: DataFrame, keys: tuple[str, ...] = ("query_id", "url"), most: int | None = MOST_RESULTS) -> DataFrame:
    """(keys, place, id, text, score, section_path, source_ids) from ranked (keys, rank, id, text, score, section_path).

    Of each group the ``most`` results that rank first are taken: merging compares pairs. None: the caller has cut
    them so. A group is one row with a list, so that Arrow carries many groups at a time.
    """
    if most is not None:
        checked_limit(most)
        results = results.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "id"))).filter(F.col("n") <= most).drop("n")
    kinds = {k: results.schema[k].dataType.simpleString() for k in keys}
    spark = results.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the shuffle that the grouping needs anyway, but with a number of parts that AQE keeps: Python has work to do in each
    lists = results.repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text", "score", "section_path"))).alias("found"))
    names = ["place", "id", "text", "score", "section_path", "source_ids"]
    types = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string())]

    def run(batches):
        for b in batches:
            rows = []
            for i, found in enumerate(b.column("found").to_pylist()):
                merged = consolidate([Scored(f["id"], f["text"], f["score"], f["section_path"]) for f in found])
                rows += [(i, place, c.id, c.text, c.score, c.section, list(c.sources)) for place, c in enumerate(merged)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(types)]], names=[*keys, *names])

    schema = ", ".join([*[f"{k} {t}" for k, t in kinds.items()], "place int, id string, text string, score double, section_path string, source_ids array<string>"])
    return lists.mapInArrow(run, schema)
