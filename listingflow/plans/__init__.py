"""Registered queries, one module per group of operators."""
from importlib import import_module

MODULES = ("scans", "publication", "extraction", "filters", "joins", "aggregates", "sequences",
           "ordering", "sets", "expressions", "streams", "extension")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
