"""Registered queries, grouped by the tables they work on."""

from importlib import import_module
from importlib.util import find_spec

MODULES = ["texts", "chunks", "indexes", "ranking", "evaluation", "wiki", "convo", "telemetry",
           "feedback", "audio", "files", "streams", "hooks"]


def load_all() -> None:
    for name in MODULES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
