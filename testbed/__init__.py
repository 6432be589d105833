"""The given tables seen as a study: named long tables derived in SQL."""
