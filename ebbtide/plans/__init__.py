"""The query catalogue."""


def catalogue():
    """All entries, in registration order. Importing a plan module registers its queries."""
    from importlib import import_module

    from .registry import ENTRIES

    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return ENTRIES


MODULES = ("churn", "ingest", "shaping", "features", "dunning", "uplift", "decisions",
           "survival", "streams", "modelling")
