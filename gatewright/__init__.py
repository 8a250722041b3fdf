"""Decision analytics on Spark: closed-set decisions as DataFrames.

The names below are imported when they are first used, so that a worker process that needs
one module does not load all.
"""

from importlib import import_module

__version__ = "0.2.0"
_HOMES = {
    "operators.gate": ("ThresholdPolicy", "decide"), "operators.metrics": ("run_benchmark",), "service": ("build_server", "decide_one"),
    "operators.seal": ("build_artifact", "build_profile", "contract_matrix", "is_sound", "verify_artifact"),
}
__all__ = sorted(n for names in _HOMES.values() for n in names)


def __getattr__(name: str):
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(f"{__name__}.{home}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
