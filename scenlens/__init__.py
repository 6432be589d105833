"""scenlens: compare long-format scenario tables on Spark.

Every step is a DataFrame transformation; nothing is collected on the driver
except where a function says so (min/max free: even map classes stay lazy).
"""
