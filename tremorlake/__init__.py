"""Velocity-change (dv/v) analytics as Spark DataFrame jobs.

Every public function takes DataFrames and returns a lazy DataFrame; nothing is
collected on the driver.  Tables are keyed (site, pair, component, config ...)
and one job covers all keys at once.
"""
