"""Registered queries with their SQL, and the detectors composed of operators."""

import importlib

MODULES = ("q_clean", "q_series", "q_state", "q_eval", "q_more", "q_rest", "q_part", "q_source", "q_stream", "q_whole", "q_modes", "q_forms")


def load() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"plantwatch.plans.{name}")
