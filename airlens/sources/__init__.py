"""Table loaders, fixture views, file scans and sinks."""

from airlens.sources.tables import Tables, tables  # noqa: F401
