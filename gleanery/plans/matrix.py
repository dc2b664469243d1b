"""Experiment matrices: components, exclusions, and the cells they expand to."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import ids
from gleanery.functions.vectors import embedder_params
from gleanery.operators import chunkers
from gleanery.operators.retrieval import RETRIEVERS
from gleanery.settings import ANNOTATIONS, canonical_json, merged, read_mapping


@dataclass(frozen=True)
class Component:
    name: str
    params: dict[str, Any] = field(default_factory=dict)
    corpora: tuple[str, ...] | None = None  # None: all

    @classmethod
    def of(cls, value: dict | str) -> "Component":
        if isinstance(value, str):
            return cls(value)
        unknown = set(value) - {"name", "params", "corpora"}
        if unknown:
            raise ValueError(f"unknown keys of a component: {sorted(unknown)}")
        return cls(value["name"], value.get("params") or {}, tuple(value["corpora"]) if value.get("corpora") is not None else None)


@dataclass(frozen=True)
class Exclusion:
    """Cells to leave out: every given field must match; embedder parameters are compared as written."""

    corpus: str | None = None
    chunker: str | None = None
    retriever: str | None = None
    embedder: str | None = None
    embedder_params: dict[str, Any] | None = None

    @classmethod
    def of(cls, value: dict) -> "Exclusion":
        embedder = value.get("embedder") or {}
        embedder = {"name": embedder} if isinstance(embedder, str) else embedder
        return cls(value.get("corpus"), value.get("chunker"), value.get("retriever"), embedder.get("name"), embedder.get("params"))

    def holds(self, corpus: str, chunker: Component, embedder: Component, retriever: Component) -> bool:
        wanted = (self.corpus, corpus), (self.chunker, chunker.name), (self.retriever, retriever.name), (self.embedder, embedder.name), (
            self.embedder_params, embedder.params,
        )
        return all(rule is None or rule == value for rule, value in wanted)


@dataclass(frozen=True)
class Experiment:
    name: str
    corpora: tuple[str, ...]
    chunkers: tuple[Component, ...]
    embedders: tuple[Component, ...]
    retrievers: tuple[Component, ...]
    exclude: tuple[Exclusion, ...] = ()
    seed: int = 42
    k: int = 10
    eval_split: str | None = None

    @classmethod
    def of(cls, data: dict) -> "Experiment":
        data = {k: v for k, v in data.items() if k == "name" or k not in ANNOTATIONS}
        unknown = set(data) - {"name", "corpora", "matrix", "exclude", "seed", "k", "eval_split"}
        if unknown:
            raise ValueError(f"unknown keys of an experiment: {sorted(unknown)}")
        if data.get("eval_split") not in (None, "train", "dev", "test"):
            raise ValueError("eval_split is train, dev or test")
        lists = [tuple(map(Component.of, data["matrix"][part])) for part in ("chunker", "embedder", "retriever")]
        return cls(
            data["name"], tuple(data["corpora"]), *lists, tuple(map(Exclusion.of, data.get("exclude") or ())), data.get("seed", 42),
            data.get("k", 10), data.get("eval_split"),
        )

    @classmethod
    def load(cls, path: str) -> "Experiment":
        return cls.of(read_mapping(path))


@dataclass(frozen=True)
class Cell:
    corpus: str
    chunker: str
    chunker_params: dict[str, Any]
    embedder: str
    embedder_params: dict[str, Any]
    retriever: str
    retriever_params: dict[str, Any]
    k: int
    chunk_set_id: str
    index_id: str
    cell_id: str
    eval_split: str | None = None


def expand(experiment: Experiment) -> list[Cell]:
    """All cells in order, with every id known before anything is built."""
    out = []
    for corpus, chunker, embedder, retriever in product(experiment.corpora, experiment.chunkers, experiment.embedders, experiment.retrievers):
        parts = chunker, embedder, retriever
        if any(c.corpora is not None and corpus not in c.corpora for c in parts) or any(rule.holds(corpus, *parts) for rule in experiment.exclude):
            continue
        if retriever.name not in RETRIEVERS:
            raise ValueError(f"unknown retriever {retriever.name!r}")
        cut, embed = chunkers.resolve(chunker.name, chunker.params), embedder_params(embedder.name, embedder.params)
        rank = merged(RETRIEVERS[retriever.name], retriever.params)
        chunk_set = ids.chunk_set_id(corpus, chunker.name, cut)
        index = ids.index_id(chunk_set, embedder.name, embed)
        cell = ids.cell_id(corpus, chunk_set, index, retriever.name, rank, experiment.k, experiment.eval_split)
        out.append(Cell(corpus, chunker.name, cut, embedder.name, embed, retriever.name, rank, experiment.k, chunk_set, index, cell, experiment.eval_split))
    return out


def as_frame(spark: SparkSession, cells: list[Cell]) -> DataFrame:
    rows = [(n, c.corpus, c.chunker, canonical_json(c.chunker_params), c.embedder, canonical_json(c.embedder_params), c.retriever, canonical_json(c.retriever_params), c.k, c.chunk_set_id, c.index_id, c.cell_id, c.eval_split) for n, c in enumerate(cells)]
    return spark.createDataFrame(
        rows,
        "position int, corpus string, chunker string, chunker_params string, embedder string, embedder_params string, retriever string, retriever_params string, k int, chunk_set_id string, index_id string, cell_id string, eval_split string",
    )


def expand_frame(corpora: DataFrame, chunkers_: DataFrame, embedders_: DataFrame, retrievers_: DataFrame, exclude: DataFrame) -> DataFrame:
    """The same product on small tables of names; a null in `exclude` (corpus, chunker, embedder, retriever) matches anything."""
    every = corpora.crossJoin(chunkers_).crossJoin(embedders_).crossJoin(retrievers_)
    rule = exclude.select(*(F.col(c).alias(f"x_{c}") for c in exclude.columns))
    match = F.lit(True)
    for c in ("corpus", "chunker", "embedder", "retriever"):
        match = match & (F.col(f"x_{c}").isNull() | (F.col(f"x_{c}") == F.col(c)))
    return every.join(F.broadcast(rule), match, "left_anti")
