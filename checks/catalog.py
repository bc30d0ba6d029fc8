"""Every registered query, next to the SQL that states the same result."""

from checks.views import with_views

QUERIES, ORACLES = {}, {}


def query(name, *views, sql=None):
    """Register a query; `views` are the ones its SQL refers to."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (with_views(*views) if views else "") + sql
        return fn

    return register


from checks import report_queries, extract_queries, ingest_queries, model_queries  # noqa: E402,F401
