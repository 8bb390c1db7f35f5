"""kpiloom: business KPI, experiment, data-quality and model-training jobs on Spark.

Every model is a function ``DataFrame -> DataFrame``; nothing is collected to the
driver except bounded results (a test report, a model, a scalar metric).
"""

__version__ = "0.1.0"
