"""Registered queries and the end-to-end jobs composed from the operators."""

from importlib import import_module

MODULES = (
    "scalar",
    "contracts",
    "reports",
    "sessions",
    "keys",
    "graphs",
    "models",
    "stores",
    "streams",
)


def load_all() -> None:
    """Import every module that registers queries."""
    import_module("pairsieve.plans.oracle")
    for name in MODULES:
        import_module(f"pairsieve.plans.{name}")
