"""turnstile: employee-turnover analytics written as Spark DataFrame jobs.

Sub-packages
------------
sources    typed scans of the input tables, the people view, sinks, model store
functions  Column-returning helpers (cost formula, labels, categories, names)
operators  table-level operators (attrition workflow, profiling, features,
           correlation, evaluation, policy value, explanations, rules, models)
plans      the query catalogue (Spark side and DuckDB oracle side)
streaming  row-local operators applied to a streaming DataFrame
"""

__version__ = "0.1.0"
