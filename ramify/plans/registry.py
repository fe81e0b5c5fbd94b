"""A catalogue of named sets. A recipe is a leaf (source and parameters) or a composition of other recipes; each resolves
to a lazy DataFrame, so a whole tree of recipes is one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..core import EngineError
from ..operators.setops import compose
from ..sources.annotation import SET_COLUMNS

Reader = Callable[..., DataFrame]


@dataclass
class Catalog:
    """Readers by name (reader(spark, **params)) and recipes by name; sets resolve once each."""

    spark: SparkSession
    readers: dict[str, Reader] = field(default_factory=dict)
    recipes: dict[str, Mapping] = field(default_factory=dict)
    _held: dict[str, DataFrame] = field(default_factory=dict)

    def register_reader(self, name: str, reader: Reader) -> None:
        self.readers[name] = reader

    def register(self, name: str, **recipe: object) -> None:
        """source=..., params={...} for a leaf; op=union or intersection, members=[...] for a composite; input=... names a set that the reader gets."""
        if ("source" in recipe) == ("op" in recipe):
            raise EngineError("register", f"{name} needs either a source or an op")
        self.recipes[name] = recipe

    def resolve(self, name: str, _path: Sequence[str] = ()) -> DataFrame:
        if name in _path:
            raise EngineError("resolve", f"cycle: {' -> '.join([*_path, name])}")
        if name not in self._held:
            if name not in self.recipes:
                raise EngineError("resolve", f"unknown set: {name}")
            r, path = self.recipes[name], (*_path, name)
            if "op" in r:
                members = [(m, self.resolve(m, path)) for m in r["members"]]
                self._held[name] = compose(members, r["op"], r.get("key", "ensembl_id"), r.get("attributes", SET_COLUMNS), uniform=r.get("uniform", ()))
            else:
                if r["source"] not in self.readers:
                    raise EngineError("resolve", f"unknown source: {r['source']}")
                params = dict(r.get("params", {}))
                if "input" in r:
                    params["input"] = self.resolve(r["input"], path)
                self._held[name] = self.readers[r["source"]](self.spark, **params)
        return self._held[name]

    def lineage(self) -> DataFrame:
        """artifact, member edges of all composites and inputs: closure() gives the whole tree."""
        edges = [(n, m) for n, r in self.recipes.items() for m in [*r.get("members", ()), *([r["input"]] if "input" in r else [])]]
        return self.spark.createDataFrame(edges, "artifact string, member string")
