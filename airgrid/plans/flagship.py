"""The shortest complete analysis: monthly statistics of a region after quality masking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from airgrid.functions.geo import region_bbox
from airgrid.operators.aggregates import aggregate_time, spatial_mean
from airgrid.operators.slicing import clip_bbox, mask_quality
from airgrid.plans import views
from airgrid.plans.registry import query, r, rounded

# fixed values: region centre and buffer
CENTRE, BUFFER_KM = (33.6844, 73.0479), 50.0


def regional_months(cube: DataFrame, bbox: Mapping[str, float]) -> DataFrame:
    """Clip, mask, reduce to one series per variable and aggregate by month."""
    return aggregate_time(spatial_mean(mask_quality(clip_bbox(cube, bbox))), "monthly")


_BOX = region_bbox(*CENTRE, BUFFER_KM)


@query(
    "flagship_regional_months",
    "grid",
    f"""WITH m AS (SELECT dataset_id, variable, time, avg(CASE WHEN qa < 3 THEN value END) AS value FROM grid
          WHERE lat BETWEEN {_BOX['south']!r} AND {_BOX['north']!r} AND lon BETWEEN {_BOX['west']!r} AND {_BOX['east']!r} GROUP BY 1, 2, 3)
        SELECT dataset_id, variable, CAST(last_day(time) AS DATE) AS period, {r('mean=avg(value)', 'std=stddev_pop(value)', 'min=min(value)',
        'max=max(value)', 'median=quantile_cont(value, .5)')} FROM m GROUP BY 1, 2, 3""",
)
def flagship(spark, sf_dir: str) -> DataFrame:
    return rounded(regional_months(views.grid(spark, sf_dir), _BOX))
