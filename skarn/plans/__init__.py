"""Registered queries: operators wired to the views, and independent SQL for their results."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from skarn.plans import prices, profiling, reviews, segmentation
from skarn.plans.oracle import prices as prices_sql
from skarn.plans.oracle import profiling as profiling_sql
from skarn.plans.oracle import reviews as reviews_sql
from skarn.plans.oracle import segmentation as segmentation_sql

QUERIES = {**profiling.QUERIES, **segmentation.QUERIES, **reviews.QUERIES, **prices.QUERIES}
ORACLE_SQL = {**profiling_sql.SQL, **segmentation_sql.SQL, **reviews_sql.SQL, **prices_sql.SQL}

cloudpickle.register_pickle_by_value(sys.modules[__name__])
