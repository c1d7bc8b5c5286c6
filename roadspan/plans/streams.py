"""Registered queries that replay the trace tables as streams, with the DuckDB SQL of the same rows at rest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from roadspan.plans import projection as P
from roadspan.plans.queries import HEAD, query, r6, rounded
from roadspan.shared import shared_dir, written
from roadspan.ship import ship
from roadspan.streaming import tracks

DELAY, BATCH, LAST = 5_000_000, 12_000_000, 3
_held_back = "obs_ord % 97 = 5"


@query(f"""WITH {P.EGO}, {P.OBS.replace("obs AS", "every AS", 1)},
mark AS (SELECT trace_id, max(t_us) - {DELAY} AS m FROM (SELECT trace_id, t_us FROM ego UNION ALL SELECT trace_id, t_us FROM every WHERE NOT {_held_back}) z GROUP BY 1),
flagged AS (SELECT every.*, {_held_back} AND t_us <= m AS late FROM every JOIN mark USING (trace_id)), obs AS (SELECT * EXCLUDE (late) FROM flagged WHERE NOT late), {P.AT}, {HEAD}
SELECT 'episode' AS kind, trace_id, CAST(obj_id AS BIGINT) AS obj_id, t_start, t_end, {r6('min_headway_s', 'min_gap_m')}, min_headway_s < 0.5 AS near_miss FROM head
UNION ALL SELECT 'late', trace_id, obj_id, t_us, t_us, NULL, NULL, NULL FROM flagged WHERE late""")
def streamed_headway(spark, sf_dir):
    """Poses and observations arrive in four shuffled micro-batches, every 97th observation after all of them; the stream goes on from its checkpoint each time."""
    jitter = (F.col("ord") * 7919 + F.coalesce("obj_id", F.lit(0)) * 104_729 + F.col("trace_id") * 31) % 2_000_000
    held = (F.col("kind") == "obs") & (F.col("ord") % 97 == 5)
    rows = tracks.arrivals(P.ego(spark, sf_dir), P.obs(spark, sf_dir))
    come = written(rows.withColumn("batch", F.when(held, LAST + 1).otherwise(F.least(F.lit(LAST), F.floor((F.col("t_us") + jitter) / BATCH)))), "arrivals")
    ends = come.select(F.lit("end").alias("kind"), "trace_id").distinct()
    none = spark.createDataFrame([], tracks.ROWS)
    at = f"{shared_dir(spark)}/headway-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in tracks.SETTINGS}
    try:
        for k, v in tracks.SETTINGS.items():
            spark.conf.set(k, v)
        ship(spark)
        for i in range(LAST + 3):
            batch = come.where(F.col("batch") == i).drop("batch") if i < LAST + 2 else none.unionByName(ends, allowMissingColumns=True)
            batch.select(*tracks.FIELDS).write.mode("append").parquet(f"{at}/in")
            found = tracks.short_headways(spark.readStream.schema(tracks.ROWS).parquet(f"{at}/in"), DELAY)
            found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return rounded(spark.read.schema(found.schema).parquet(f"{at}/out"), "min_headway_s", "min_gap_m")
