"""Named queries over the test tables. Importing a module registers its queries."""

from importlib import import_module

MODULES = ("retrieval", "searching", "answering", "ingestion", "graph", "telemetry", "quality", "conversion", "records", "facts", "code", "events", "sinks")


def load_all() -> None:
    for m in MODULES:
        try:
            import_module(f"{__name__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{m}":
                raise
