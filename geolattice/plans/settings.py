"""Settings: a request's conf, then the session's, then the stored table, then the defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

DEFAULTS: dict[str, Any] = {
    "context": "off",
    "context_estimated_count": 100_000,
    "context_estimated_cost": 100_000,
    "context_stats_ttl": 86_400,
    "default_filter_lang": "cql2-json",
    "additional_properties": True,
    "use_queue": False,
    "queue_timeout": 600,
    "update_collection_extent": False,
    "base_url": ".",
    "readonly": False,
}


def as_bool(value: Any) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "t", "on", "1", "yes")


@dataclass
class Settings:
    """`stored` plays the part of the settings table; spark.conf keys geolattice.<name> that of the session."""

    spark: SparkSession | None = None
    stored: dict[str, Any] = field(default_factory=dict)
    save: Callable[[dict[str, Any]], Any] | None = None  # what keeps the table, if anything does

    def get(self, name: str, conf: dict | None = None) -> Any:
        if conf and conf.get(name) is not None:
            return conf[name]
        if self.spark is not None and (found := self.spark.conf.get(f"geolattice.{name}", None)) is not None:
            return found
        return self.stored.get(name, DEFAULTS.get(name))

    def flag(self, name: str, conf: dict | None = None) -> bool:
        return as_bool(self.get(name, conf))

    def set(self, name: str, value: Any) -> None:
        """Stored, so that whoever opens the catalog next has it too."""
        self.stored[name] = value
        if self.save is not None:
            self.save(self.stored)
