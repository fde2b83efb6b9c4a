"""Workload lifecycle analytics as DataFrame -> DataFrame operators.

Operators are plain functions over DataFrames whose columns are named in
``fleetfold.schema``. They build logical plans and leave the physical strategy
to Spark; nothing here collects a table to the driver.
"""
