"""shopsignal — retail customer intelligence as Spark DataFrame jobs.

Sub-packages:
  sources    readers and the retail views over the driver tables
  functions  column-expression helpers and fixed business values
  operators  the analytics (cleaning, features, scoring, mining, recommending, roll-ups)
  plans      the query catalog (one DataFrame per operator) and its SQL oracle
  streaming  incremental refresh of the batch outputs from a file stream
"""

__all__ = ["session"]
