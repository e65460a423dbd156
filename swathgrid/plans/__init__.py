"""Named queries over the given tables."""


def load():
    """All registered queries by name."""
    from importlib import import_module

    for module in ("observations", "rasters", "patches", "catalogues", "learning", "products"):
        import_module(f"swathgrid.plans.{module}")
    from swathgrid.plans.registry import QUERIES

    return QUERIES
