"""The entity dictionary as YAML, which people edit between extraction and rewriting, or as a Parquet table where it is too large for that.

In the file each category stands under its upper-case name, with a list of entities: id, variants (a list of texts) and, without
effect, pattern. Categories may be missing; names that aren't known are passed over; anything else is an error that says where."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import CATEGORIES

LONG = "category string, entity_no int, id string, variant_no int, variant string, pattern string"


class Named(NamedTuple):
    id: str
    variants: tuple[str, ...]
    pattern: str | None

    def plain(self) -> dict:
        shown = {"id": self.id, "variants": list(self.variants)}
        return shown if self.pattern is None else shown | {"pattern": self.pattern}


def _read(entry: object, where: str) -> Named:
    if not isinstance(entry, Mapping):
        raise ValueError(f"{where}: an entity has id and variants")
    texts = entry.get("variants")
    if not isinstance(entry.get("id"), str):
        raise ValueError(f"{where}: the id has to be a text")
    if not isinstance(texts, (list, tuple)) or not all(isinstance(x, str) for x in texts):
        raise ValueError(f"{where}: variants have to be a list of texts")
    if not isinstance(entry.get("pattern"), (str, type(None))):
        raise ValueError(f"{where}: the pattern has to be a text")
    return Named(entry["id"], tuple(texts), entry.get("pattern"))


class Dictionary:
    """The entities of each category, in order; by_category and, for short, an attribute for each."""

    def __init__(self, entries: object = None):
        if not isinstance(entries or {}, Mapping):
            raise ValueError("a dictionary has a list of entities for each category")
        self.by_category: dict[str, list[Named]] = {}
        for c in CATEGORIES:
            listed = (entries or {}).get(c.upper(), [])
            if not isinstance(listed, (list, tuple)):
                raise ValueError(f"{c.upper()}: a list of entities")
            self.by_category[c] = [_read(x, f"{c.upper()}, entity {k}") for k, x in enumerate(listed, 1)]

    def __getattr__(self, name: str) -> list[Named]:
        try:
            return self.__dict__["by_category"][name]
        except KeyError:
            raise AttributeError(name) from None

    def extend(self, other: "Dictionary") -> None:
        for c, some in other.by_category.items():
            self.by_category[c] += some

    def plain(self) -> dict:
        return {c.upper(): [x.plain() for x in some] for c, some in self.by_category.items()}


class _Quoted(str):
    pass


class _Dumper(yaml.SafeDumper):
    pass


_Dumper.add_representer(_Quoted, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", str(s), style='"'))


def _quoted(x):
    if isinstance(x, dict):
        return {k: _quoted(v) for k, v in x.items()}
    return [_quoted(v) for v in x] if isinstance(x, list) else _Quoted(x) if isinstance(x, str) else x


def to_yaml(entities: Dictionary) -> str:
    """All strings in double quotes, all eight categories, nulls left out."""
    return yaml.dump(_quoted(entities.plain()), Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=1 << 20)


def from_yaml(text: str) -> Dictionary:
    return Dictionary(yaml.safe_load(text))


def to_rows(spark: SparkSession, entities: Dictionary) -> DataFrame:
    rows = [(c, n, x.id, k, v, x.pattern) for c, some in entities.by_category.items() for n, x in enumerate(some, 1) for k, v in enumerate(x.variants, 1)]
    if any(not r[4] for r in rows):
        raise ValueError("a variant is empty")
    return spark.createDataFrame(rows, LONG)


def from_rows(table: DataFrame) -> Dictionary:
    """The dictionary on the driver: for the file that people review."""
    out = Dictionary()
    for r in table.orderBy("category", "entity_no", "variant_no").collect():
        some = out.by_category[r.category]
        if r.variant_no == 1:
            some.append(Named(r.id, (), r.pattern))
        some[-1] = some[-1]._replace(variants=(*some[-1].variants, r.variant))
    return out
