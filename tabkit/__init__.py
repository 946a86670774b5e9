"""Profiling, cleaning, describing and modelling of large tables on Spark.

``sources``    reading tables and looking at their shape
``functions``  column expressions without any Python worker
``operators``  functions from DataFrame to DataFrame
``plans``      the arrests-shaped and the poverty-shaped analysis end to end
"""
