"""Registries of drivers, definitions and backends by name, and height functions built from their definitions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame

from tessera.functions.scalars import superelevation

T = TypeVar("T")


class Registry(Generic[T]):
    """name -> thing; a name is registered once, and an unknown one says which there are."""

    def __init__(self, what: str):
        self.what, self.held = what, {}

    def register(self, name: str, thing: T) -> T:
        if name in self.held:
            raise ValueError(f"{self.what} {name} is registered already")
        self.held[name] = thing
        return thing

    def get(self, name: str) -> T:
        if name not in self.held:
            raise KeyError(f"no {self.what} {name}; there are {sorted(self.held)}")
        return self.held[name]


GENERATORS: Registry[Callable] = Registry("generator")
DEFINITIONS: Registry[str] = Registry("definition schema")
BACKENDS: Registry[Callable] = Registry("backend")
HEIGHTS: Registry[Callable[[dict], Callable[[Column], Column]]] = Registry("height function")


def _superelevation(d: dict) -> Callable[[Column], Column]:
    (h0, h1), (s0, s1) = d["heightRange"], d["scaleRange"]
    return lambda h: superelevation(h, float(h0), float(h1), float(s0), float(s1))


HEIGHTS.register("superelevation", _superelevation)


def height_function(definition: dict | None) -> Callable[[Column], Column]:
    """The function of a definition; none leaves heights as they are."""
    return HEIGHTS.get(definition["function"])(definition) if definition else lambda h: h


def provider(generator: object, interface: str, use: Callable[[object], T]) -> T:
    """use(generator), where it offers the interface; an error says that it does not."""
    if not callable(getattr(generator, interface, None)):
        raise TypeError(f"{type(generator).__name__} provides no {interface}")
    return use(generator)


def postprocessed(features: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """features through each step in turn; a step keeps all columns, or is an error."""
    out = features
    for step in steps:
        out = out.transform(step)
        if lost := [c for c in features.columns if c not in out.columns]:
            raise ValueError(f"a step dropped {lost}")
    return out
