"""Extensions: named plugins that register sources, functions and views on a session, once each."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession


class Plugin:
    """Hooks of an extension, in the order in which they are called."""

    name = "plugin"

    def build(self, spark: SparkSession) -> None: ...

    def ready(self, spark: SparkSession) -> bool:
        return True

    def finish(self, spark: SparkSession) -> None: ...

    def cleanup(self, spark: SparkSession) -> None: ...


class Sources(Plugin):
    """The map formats."""

    name = "sources"

    def build(self, spark: SparkSession) -> None:
        from geoloom.sources.changes import ChangeSource
        from geoloom.sources.pbf import PbfSource

        spark.dataSource.register(PbfSource)
        spark.dataSource.register(ChangeSource)


class App:
    """Plugins of a session, and values and events that they share."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.plugins: dict[str, Plugin] = {}
        self.resources: dict[type, object] = {}
        self.handlers: dict[type, list[Callable]] = {}

    def add(self, *plugins: Plugin | Iterable[Plugin]) -> App:
        """Adds plugins or groups of them; a name that is there already is left out."""
        for p in plugins:
            if isinstance(p, Plugin):
                if p.name not in self.plugins:
                    self.plugins[p.name] = p
                    p.build(self.spark)
            else:
                self.add(*p)
        return self

    def start(self) -> App:
        late = [p.name for p in self.plugins.values() if not p.ready(self.spark)]
        if late:
            raise RuntimeError(f"not ready: {', '.join(late)}")
        for p in self.plugins.values():
            p.finish(self.spark)
        return self

    def stop(self) -> None:
        for p in reversed(self.plugins.values()):
            p.cleanup(self.spark)

    def put(self, value: object) -> None:
        self.resources[type(value)] = value

    def get(self, kind: type):
        return self.resources.get(kind)

    def on(self, kind: type, handler: Callable) -> None:
        self.handlers.setdefault(kind, []).append(handler)

    def emit(self, event: object) -> None:
        for h in self.handlers.get(type(event), ()):
            h(event)
