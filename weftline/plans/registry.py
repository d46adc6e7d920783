"""All registered queries and their SQL twins; the plan modules fill them when they are imported here."""

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict = {}
MODULES = ("splits", "mapping", "profiles", "vectors", "outfits", "prices", "listings", "activity", "texts", "advice", "insights", "learned", "calibration")


def query(sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its own name, with the SQL that gives the same rows."""

    def add(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLE[plan.__name__] = sql
        return plan

    return add


for _name in MODULES:
    import_module(f"weftline.plans.{_name}")
