"""Plugins: sources, extractors and embedders, found as entry points or registered by hand."""

from __future__ import annotations

import logging
from importlib import metadata
from typing import Any

from pyspark.sql import SparkSession

GROUPS = {"source": "millrace.sources", "extractor": "millrace.extractors", "embedder": "millrace.embedders"}
_log = logging.getLogger(__name__)


class Registry:
    """A name registered by hand wins over an installed one; an entry point that fails to load is skipped."""

    def __init__(self) -> None:
        self._own: dict[str, dict[str, Any]] = {k: {} for k in GROUPS}
        self._found: dict[str, dict[str, Any]] | None = None

    def register(self, kind: str, name: str, plugin: Any) -> None:
        self._own[kind][name] = plugin

    def _installed(self) -> dict[str, dict[str, Any]]:
        if self._found is None:
            self._found = {k: {} for k in GROUPS}
            for kind, group in GROUPS.items():
                for point in metadata.entry_points(group=group):
                    try:
                        self._found[kind][point.name] = point.load()
                    except Exception as e:
                        _log.warning("plugin %s of %s cannot be loaded: %s", point.name, group, e)
        return self._found

    def names(self, kind: str) -> list[str]:
        return sorted({*self._own[kind], *self._installed()[kind]})

    def get(self, kind: str, name: str) -> Any:
        for held in (self._own[kind], self._installed()[kind]):
            if name in held:
                return held[name]
            for plugin in held.values():
                if getattr(plugin, "plugin_id", None) == name:
                    return plugin
        raise KeyError(f"no {kind} named {name!r}; there are {', '.join(self.names(kind)) or 'none'}")

    def capabilities(self) -> dict[str, dict]:
        """What the registered extractors take, in the form that routing expects."""
        out = {}
        for name in self.names("extractor"):
            e = self.get("extractor", name)
            out[name] = {"mimes": tuple(getattr(e, "mimes", ())), "extensions": tuple(getattr(e, "extensions", ())), "priority": getattr(e, "priority", 0)}
        return out


default = Registry()


def register_data_sources(spark: SparkSession) -> None:
    from millrace.sources.git import GitSource
    from millrace.sources.web import WebSource

    for source in (GitSource, WebSource):
        spark.dataSource.register(source)
