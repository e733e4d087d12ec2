"""Segmentation, review scoring and price-series operators on Spark DataFrames."""

from pyspark import cloudpickle

from skarn import functions, operators, sources, streaming

__version__ = "0.2.0"

# The few Python functions of these folders that run in tasks travel with the job, so that
# workers need no installed copy of them.
for _folder in (functions, operators, sources, streaming):
    cloudpickle.register_pickle_by_value(_folder)
