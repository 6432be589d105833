from pyspark.errors import PySparkException


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def one(df):
    (row,) = df.collect()
    return tuple(row) if len(row) > 1 else row[0]


def message_of(df):
    """Error text of a job that must fail."""
    try:
        df.collect()
    except PySparkException as exc:
        return str(exc)
    raise AssertionError("the job did not fail")
