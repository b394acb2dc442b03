"""eventide: event-sequence analytics on Spark.

events table -> token streams -> cohorts and labels -> conditional
next-token scores -> ranking metrics, all as DataFrame jobs.
"""

__version__ = "0.1.0"
