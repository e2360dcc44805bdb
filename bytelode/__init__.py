"""Carving of embedded files out of raw bytes, and recovery of fragmented JPEGs, as Spark DataFrame jobs."""

from importlib import import_module

_WHERE = {
    "bytelode.operators.specs": ("Spec", "builtin_specs", "combined_specs", "load_specs", "save_specs", "select_types"),
    "bytelode.plans.carve": ("CarveConfig", "carve"),
    "bytelode.operators.recover": ("RecoveryConfig", "recover"),
}
__all__ = ["CarveConfig", "RecoveryConfig", "Spec", "builtin_specs", "carve", "combined_specs", "load_specs", "recover", "save_specs", "select_types"]


def __getattr__(name: str) -> object:
    """Public names load when first used: Python workers import single modules of this package and need little."""
    for module, names in _WHERE.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(name)
