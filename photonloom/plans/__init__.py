"""Queries over the driver tables."""


def load():
    """Import every query module and return the registry."""
    import importlib
    import pkgutil

    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")
