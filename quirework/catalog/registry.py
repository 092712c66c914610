"""Name -> (operator ids, function, SQL)."""

QUERIES = {}


def query(ids, sql=None):
    def add(fn):
        name = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = (ids, fn, sql)
        return fn

    return add


def queries():
    return {name: fn for name, (_, fn, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, _, sql) in QUERIES.items() if sql}


def survey_ids():
    return {name: ids for name, (ids, _, _) in QUERIES.items()}
