"""Running an experiment's cells, and reporting on runs.

The build stage makes every chunk set and index once; each cell is one plan over
its whole eval set.  A finished cell is a written artifact, so a run that is
started again goes on where it stopped.
"""

from __future__ import annotations

import json
import logging
import time
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import ids
from gleanery.operators import metrics, relations, retrieval
from gleanery.plans.matrix import Cell, Experiment, as_frame, expand
from gleanery.sources.artifacts import Catalogue, VectorStore

log = logging.getLogger(__name__)


def build(catalogue: Catalogue, cells: list[Cell], force: bool = False) -> None:
    """Each distinct chunk set and index of the cells, once."""
    for cell in {c.index_id: c for c in cells}.values():
        catalogue.build_chunk_set(cell.corpus, cell.chunker, cell.chunker_params, force=force and not catalogue.ready("chunks", cell.chunk_set_id))
        catalogue.build_index(cell.chunk_set_id, cell.embedder, cell.embedder_params, force=force)


def evaluate(catalogue: Catalogue, cell: Cell) -> DataFrame:
    """A row per eval pair of the cell (see metrics.traces), with the cell's ids."""
    pairs = catalogue.load_evalset(cell.corpus, cell.eval_split)
    chunks = catalogue.load_chunk_set(cell.chunk_set_id)
    hits = retrieval.retrieve(
        cell.retriever, pairs.select("query_id", "query"), chunks, VectorStore(catalogue, cell.index_id).rows(), cell.k,
        cell.retriever_params, cell.embedder, cell.embedder_params,
    )
    rows = metrics.traces(pairs, hits, relations.resolve_gold(pairs, chunks), chunks, cell.k)
    return rows.withColumn("cell_id", F.lit(cell.cell_id)).withColumn("corpus", F.lit(cell.corpus))


def run(catalogue: Catalogue, experiment: Experiment, run_id: str | None = None, force: bool = False, workers: int = 1) -> str:
    """Build, evaluate what isn't finished, write; gives the run's id.

    `workers` cells are evaluated at a time, their jobs sharing the cluster.  A
    cell that fails ends the run; finished ones stay.  No cell at all is an
    error.
    """
    cells = expand(experiment)
    if not cells:
        raise ValueError(f"no cell is left in {experiment.name!r}: every combination is excluded")
    run_id = run_id or ids.run_id(experiment.name)
    spark = catalogue.spark
    catalogue.write("results", f"{run_id}/matrix", as_frame(spark, cells))
    build(catalogue, cells)

    def evaluated(cell: Cell) -> None:
        name = f"{run_id}/cell_{cell.cell_id}"
        began = time.monotonic()
        rows = catalogue.write("results", name, evaluate(catalogue, cell))
        total, out = rows.agg(F.count("*"), F.sum(F.col("excluded").cast("int"))).first()
        if total and total == out:
            log.warning("every pair of cell %s is excluded: do its documents and its eval set agree on ids?", cell.cell_id)
        catalogue._put(f"{catalogue.path('results', name)}.json", json.dumps({"batch_seconds": time.monotonic() - began, "queries": total}))

    left = [c for c in cells if force or not catalogue.ready("results", f"{run_id}/cell_{c.cell_id}")]
    with ThreadPoolExecutor(max(1, workers)) as pool:
        jobs = [pool.submit(evaluated, cell) for cell in left]
        try:
            for job in as_completed(jobs):
                job.result()
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    return run_id


def load(catalogue: Catalogue, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(cells in order, traces of the finished ones); cells that aren't finished are absent from the traces."""
    cells = catalogue.read("results", f"{run_id}/matrix")
    done = [r["cell_id"] for r in cells.select("cell_id").collect() if catalogue.ready("results", f"{run_id}/cell_{r['cell_id']}")]
    if not done:
        raise LookupError(f"run {run_id!r} has no finished cell")
    paths = [catalogue.path("results", f"{run_id}/cell_{c}") for c in done]
    return cells, catalogue.spark.read.option("mergeSchema", "true").parquet(*paths)


def pending(catalogue: Catalogue, run_id: str) -> list[str]:
    cells, rows = load(catalogue, run_id)
    return [r["cell_id"] for r in cells.join(rows.select("cell_id").distinct(), "cell_id", "left_anti").orderBy("position").collect()]


def report(catalogue: Catalogue, run_id: str, metric: str = "recall_5") -> DataFrame:
    """The cells in order with all means, and the interval of one metric."""
    cells, rows = load(catalogue, run_id)
    interval = metrics.bootstrap(rows.filter("not excluded"), ["cell_id"], metric, "query_id").select("cell_id", "low", "high")
    return cells.join(metrics.summary(rows, ["cell_id"]), "cell_id").join(interval, "cell_id", "left").orderBy("position")


def report_markdown(catalogue: Catalogue, run_id: str, metric: str = "recall_5") -> str:
    rows = report(catalogue, run_id, metric).collect()
    names = [c for c in rows[0].asDict() if c in ("queries", "excluded", "mrr", "ndcg_10", "chunk_efficiency", "all_spans_hit", "low", "high") or c.startswith("recall_")]
    label = lambda r: " / ".join((r["corpus"], r["chunker"], r["embedder"], r["retriever"]))
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| cell | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    return "\n".join([*lines, *(f"| {label(r)} | " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)])


def compare(catalogue: Catalogue, run_ids: list[str], metric: str = "recall_5") -> DataFrame:
    """cell_id and the metric in each run, for the cells that all runs have."""
    if len(run_ids) < 2:
        raise ValueError("comparing needs two runs or more")
    out: DataFrame | None = None
    for n, run_id in enumerate(run_ids):
        one = metrics.summary(load(catalogue, run_id)[1], ["cell_id"]).select("cell_id", F.col(metric).alias(f"run_{n + 1}"))
        out = one if out is None else out.join(one, "cell_id")
    return out


def failures(catalogue: Catalogue, run_id: str, position: int = 0, n: int = 20) -> DataFrame:
    """The worst queries of the cell at a position of the matrix."""
    cells, rows = load(catalogue, run_id)
    cell = cells.filter(F.col("position") == position).first()
    if cell is None:
        raise LookupError(f"no cell {position} in {run_id!r}")
    return metrics.worst(rows.filter(F.col("cell_id") == cell["cell_id"]), n)
