"""What the tests compare by."""

def rows(df):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shape(schema):
    """Names and types; whether a column may be null is left open."""
    return [(f.name, f.dataType.simpleString()) for f in schema]
