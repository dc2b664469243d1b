"""Command line: python -m gleanery COMMAND ...

Exit codes: 0 done, 1 an expected error, 2 an unexpected one.
"""

from __future__ import annotations

import argparse
import json
import logging
import random
import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import __version__, doctor, logs, schema
from gleanery.functions.text import preview
from gleanery.operators import chunkers, relations, retrieval, stats
from gleanery.plans import agents, experiment
from gleanery.plans.matrix import Experiment
from gleanery.settings import Settings, load_settings, overrides
from gleanery.sources import files, jsonl
from gleanery.sources.artifacts import Catalogue, VectorStore

EXPECTED = (ValueError, LookupError, FileNotFoundError, RuntimeError)


class App:
    """What all commands share; the session starts when it's first needed."""

    def __init__(self, options: argparse.Namespace):
        self.options = options
        self.settings: Settings = load_settings(options.config, overrides(options.set))
        self._catalogue: Catalogue | None = None

    @property
    def catalogue(self) -> Catalogue:
        if self._catalogue is None:
            from gleanery.session import local_session

            self._catalogue = Catalogue(local_session(), self.settings.paths.artifacts, self.settings.paths.fixtures)
        return self._catalogue

    def show(self, rows: DataFrame) -> None:
        """All rows, one partition after another."""
        names = rows.columns
        print("\t".join(names))
        for row in rows.toLocalIterator():
            print("\t".join("-" if row[c] is None else str(row[c]) for c in names))


def corpus_build(app: App) -> None:
    root = app.settings.paths.corpora
    names = files.discover(app.catalogue.spark, root) if app.options.all else [app.options.corpus]
    failed = []
    for name in names:
        try:
            rows = app.catalogue.write(
                "documents", name,
                files.load(app.catalogue.spark, f"{root}/{name}", name, root.rstrip("/").rpartition("/")[0]).orderBy("source_path"),
            )
            print(f"{name}: {rows.count()} documents")
        except Exception as error:  # the other corpora are built all the same
            logging.getLogger("gleanery").error("%s: %s", name, error)
            failed.append(name)
    if failed or not names:
        raise RuntimeError(f"not built: {failed or 'there is no corpus'}")


def corpus_stats(app: App) -> None:
    for name in [app.options.corpus] if app.options.corpus else app.catalogue.names("documents"):
        rows = app.catalogue.read("documents", name, True)
        app.show(stats.corpus_stats(rows))
        app.show(stats.language_mix(rows).orderBy(F.desc("docs"), "label"))


def corpus_show(app: App) -> None:
    for name in app.catalogue.names("documents"):
        row = files.find_document(app.catalogue.read("documents", name), app.options.doc_id).first()
        if row:
            print(f"{row['title']} ({row['source_path']})\n{row['text'][: app.options.chars]}")
            return
    raise LookupError(f"no document {app.options.doc_id!r}")


def chunk_run(app: App) -> None:
    o = app.options
    name, rows = app.catalogue.build_chunk_set(o.corpus, o.chunker or app.settings.defaults.chunker, overrides(o.param), o.role, o.parent_chunk_set, o.force)
    print(f"{name}: {rows.count()} chunks of {rows.select('doc_id').distinct().count()} documents")


def _set(app: App, name: str) -> tuple[DataFrame, DataFrame]:
    rows = app.catalogue.load_chunk_set(name)
    return rows, app.catalogue.read("documents", rows.first()["corpus"])


def chunk_stats(app: App) -> None:
    app.show(stats.chunk_stats(*_set(app, app.options.chunk_set)))


def chunk_show(app: App) -> None:
    rows = app.catalogue.load_chunk_set(app.options.chunk_set).filter(F.col("doc_id") == app.options.doc_id)
    shared = relations.overlap_with_previous(rows)
    app.show(rows.join(shared, ["chunk_set_id", "doc_id", "ordinal"]).orderBy("char_start", "char_end").select("ordinal", "char_start", "char_end", "token_count", "shared", preview(F.col("text")).alias("text")))


def chunk_diff(app: App) -> None:
    side = lambda name, s: app.catalogue.load_chunk_set(name).filter(F.col("doc_id") == app.options.doc_id).select(
        "char_start", "char_end", F.lit(s).alias("set"), preview(F.col("text")).alias("text"),
    )
    app.show(side(app.options.a, "a").unionByName(side(app.options.b, "b")).orderBy("char_start", "char_end", "set"))


def index_build(app: App) -> None:
    o = app.options
    over = overrides(o.param) | ({"truncate_dim": o.truncate_dim} if o.truncate_dim else {})
    print(app.catalogue.build_index(o.chunk_set, o.embedder or app.settings.defaults.embedder, over, o.force))


def index_list(app: App) -> None:
    for m in app.catalogue.manifests(app.options.corpus):
        print(f"{m['index_id']}\t{m['vector_count']} vectors\tdim {m['dim']}\t{m['embedder']}")


def _retrieved(app: App, retriever: str, params: dict) -> DataFrame:
    o = app.options
    manifest = app.catalogue.manifest(o.index)
    if manifest is None:
        raise LookupError(f"no index {o.index!r}")
    chunks = app.catalogue.load_chunk_set(manifest["chunk_set_id"])
    asked = app.catalogue.spark.createDataFrame([("q", o.query)], "query_id string, query string")
    hits = retrieval.retrieve(
        retriever, asked, chunks, VectorStore(app.catalogue, o.index).rows(), o.k or app.settings.defaults.k, params, manifest["embedder"],
        json.loads(manifest["embedder_params"]),
    )
    known = chunks if not getattr(o, "parent_chunk_set", None) else chunks.unionByName(app.catalogue.load_chunk_set(o.parent_chunk_set))
    texts = known.select("chunk_id", preview(F.col("text"), 100).alias("text")).dropDuplicates(["chunk_id"])
    return hits.join(texts, "chunk_id", "left").orderBy("rank").select("retriever", "rank", "score", "chunk_id", "text")


def index_search(app: App) -> None:
    app.show(_retrieved(app, "dense", {}))


def retrieve_query(app: App) -> None:
    app.show(_retrieved(app, app.options.retriever or app.settings.defaults.retriever, overrides(app.options.param)))


def retrieve_compare(app: App) -> None:
    names = app.options.retrievers.split(",")
    unknown = sorted(set(names) - set(retrieval.RETRIEVERS))
    if unknown:
        raise ValueError(f"unknown retrievers: {unknown}")
    params = overrides(app.options.param)
    for name in names:
        app.show(_retrieved(app, name, params.get(name) or {}))


def evalset_build(app: App) -> None:
    """Needles (JSON Lines: needle_id, query, needles) anchored in a corpus."""
    from gleanery import ids

    o = app.options
    needles = app.catalogue.spark.read.schema("needle_id string, query string, needles array<string>, difficulty string").json(o.needles).withColumn("corpus", F.lit(o.corpus))
    found = relations.needle_evalset(app.catalogue.read("documents", o.corpus), needles.select("needle_id", "corpus", "query", "needles"))
    rows = found.join(
        needles.select("needle_id", F.col("needles").alias("supporting_quotes"), F.coalesce("difficulty", F.lit("lookup")).alias("difficulty")),
        "needle_id",
    )
    identity = ids.query_id(F.col("corpus"), F.col("gold_doc_id"), F.col("gold_char_spans"), F.col("query"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("query_id", identity).withColumn("split", ids.split_of(identity)).withColumn("sampling_chunk_ids", none).withColumn(
        "generator_model", F.lit("needles"),
    ).withColumn("validated", F.lit(True)).withColumn(
        "answer", F.lit(None).cast("string"),
    )
    written = app.catalogue.write("evalset", o.corpus, rows.select(*(f.name for f in schema.EVAL_PAIR.fields)))
    print(f"{written.count()} pairs of {needles.count()} needles")


def evalset_validate(app: App) -> None:
    """Every span must lie in its document and hold its quote."""
    pairs, docs = app.catalogue.load_evalset(app.options.corpus), app.catalogue.read("documents", app.options.corpus)
    rows = pairs.join(docs.select(F.col("doc_id").alias("gold_doc_id"), "text"), "gold_doc_id", "left")
    good = F.forall(
        F.arrays_zip("gold_char_spans", "supporting_quotes"),
        lambda z: F.substring(F.col("text"), z["gold_char_spans"][0] + 1, z["gold_char_spans"][1] - z["gold_char_spans"][0]) == z["supporting_quotes"],
    )
    bad = rows.filter(~F.coalesce(good, F.lit(False))).select("query_id", "query")
    n = bad.count()
    app.show(bad)
    if n:
        raise ValueError(f"{n} pairs don't hold")


def evalset_stats(app: App) -> None:
    app.show(app.catalogue.load_evalset(app.options.corpus).groupBy("split", "difficulty").count().orderBy("split", "difficulty"))


def evalset_review(app: App) -> None:
    app.show(app.catalogue.load_evalset(app.options.corpus).orderBy("query_id").limit(app.options.n).select("query_id", "query", "gold_doc_id", "supporting_quotes"))


def experiment_run(app: App) -> None:
    print(experiment.run(app.catalogue, Experiment.load(app.options.file), app.options.run_id, app.options.force, app.options.workers))


def experiment_report(app: App) -> None:
    if app.options.format == "markdown":
        print(experiment.report_markdown(app.catalogue, app.options.run_id))
    else:
        app.show(experiment.report(app.catalogue, app.options.run_id).drop("chunker_params", "embedder_params", "retriever_params", "chunk_set_id", "index_id"))


def experiment_compare(app: App) -> None:
    app.show(experiment.compare(app.catalogue, app.options.run_ids))


def experiment_failures(app: App) -> None:
    app.show(experiment.failures(app.catalogue, app.options.run_id, app.options.config_idx, app.options.n).select("query_id", "query", "first_hit_rank", "excluded"))


def agent_route(app: App) -> None:
    o = app.options
    found = agents.route(app.catalogue, o.query, o.corpus, o.k or app.settings.defaults.k, budget=agents.Budget(o.max_steps))
    print(f"{found.retriever} on {found.index_id}")
    for hit in found.hits:
        print(f"{hit['rank']}\t{hit['score']}\t{hit['chunk_id']}\t{hit['preview']}")
    if o.explain:
        print(json.dumps(found.outcome.turns, indent=1))


def _trace_file(app: App, run_id: str) -> str:
    return f"{app.settings.paths.results}/{run_id}.trace.jsonl"


def agent_optimize(app: App) -> None:
    from gleanery import ids

    o = app.options
    run = ids.run_id(f"optimize-{o.corpus}")
    budget = agents.Budget(o.max_steps_per_iteration, o.max_tokens, o.max_wall_clock, o.budget_usd)
    agents.optimize(app.catalogue, o.corpus, o.k or app.settings.defaults.k, o.max_iterations, budget=budget, trace=_trace_file(app, run), name=run)
    print(run)


def agent_trace(app: App) -> None:
    for e in agents.load_trace(app.catalogue, _trace_file(app, app.options.run_id)):
        print(f"{e.iteration}\t{e.split}\t{e.config.get('chunker')}\trecall_5 {e.metrics.get('recall_5')}\t{e.diagnosis}\t{e.mutation}")


def doctor_(app: App) -> None:
    checks = doctor.run(app.settings.paths.artifacts, app.settings.paths.fixtures)
    print(doctor.render(checks))
    if not doctor.healthy(checks):
        raise RuntimeError("a core check failed")


def artifact_import(app: App) -> None:
    """JSON Lines of a known kind into the catalogue."""
    kinds = {"documents": schema.DOCUMENT, "chunks": schema.CHUNK, "evalset": schema.EVAL_PAIR}
    rows = jsonl.read(app.catalogue.spark, app.options.file, kinds[app.options.kind])
    print(app.catalogue.write(app.options.kind, app.options.name, rows).count())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleanery")
    top.add_argument("--config")
    top.add_argument("--set", action="append", metavar="KEY=VALUE")
    top.add_argument("--seed", type=int)
    top.add_argument("--log-level")
    top.add_argument("--json-logs", action="store_true", default=None)
    groups = top.add_subparsers(dest="group", required=True)
    groups.add_parser("version").set_defaults(run=lambda app: print(__version__))
    groups.add_parser("doctor").set_defaults(run=doctor_)
    groups.add_parser("config").set_defaults(run=lambda app: print(json.dumps(app.settings.as_dict(), indent=1)))
    made: dict[str, argparse._SubParsersAction] = {}

    def command(group: str, name: str, run, *arguments) -> None:
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        sub = made[group].add_parser(name)
        for argument in arguments:
            flags, options = argument if isinstance(argument, tuple) else (argument, {})
            sub.add_argument(flags, **options)
        sub.set_defaults(run=run)

    flag, number = {"action": "store_true"}, {"type": int}
    param, k, corpus = ("--param", {"action": "append"}), ("--k", number), ("--corpus", {})
    command("corpus", "build", corpus_build, corpus, ("--all", flag))
    command("corpus", "stats", corpus_stats, corpus)
    command("corpus", "show", corpus_show, "doc_id", ("--chars", {"type": int, "default": 500}))
    command("corpus", "import", artifact_import, ("kind", {"choices": ["documents", "chunks", "evalset"]}), "name", "file")
    command(
        "chunk", "run", chunk_run, "corpus", ("--chunker", {"choices": chunkers.available()}), param, ("--role", {"default": "standalone"}),
        ("--parent-chunk-set", {}), ("--force", flag),
    )
    command("chunk", "stats", chunk_stats, "chunk_set")
    command("chunk", "show", chunk_show, "chunk_set", "doc_id")
    command("chunk", "diff", chunk_diff, "a", "b", "doc_id")
    command("index", "build", index_build, "chunk_set", ("--embedder", {}), ("--truncate-dim", number), param, ("--force", flag))
    command("index", "list", index_list, corpus)
    command("index", "search", index_search, "index", "query", k)
    command("retrieve", "query", retrieve_query, "index", "query", ("--retriever", {}), k, param, ("--parent-chunk-set", {}))
    command("retrieve", "compare", retrieve_compare, "index", "query", ("--retrievers", {"default": "dense,bm25,hybrid"}), k, param, ("--parent-chunk-set", {}))
    command("evalset", "build", evalset_build, "corpus", "needles")
    command("evalset", "validate", evalset_validate, "corpus")
    command("evalset", "stats", evalset_stats, "corpus")
    command("evalset", "review", evalset_review, "corpus", ("--n", {"type": int, "default": 10}))
    command("experiment", "run", experiment_run, "file", ("--run-id", {}), ("--force", flag), ("--workers", {"type": int, "default": 1}))
    command("experiment", "report", experiment_report, "run_id", ("--format", {"choices": ["table", "markdown"], "default": "table"}))
    command("experiment", "compare", experiment_compare, ("run_ids", {"nargs": "+"}))
    command("experiment", "failures", experiment_failures, "run_id", ("--config-idx", {"type": int, "default": 0}), ("--n", {"type": int, "default": 20}))
    command("agent", "route", agent_route, "query", "corpus", k, ("--max-steps", {"type": int, "default": 5}), ("--explain", flag))
    command(
        "agent", "optimize", agent_optimize, "corpus", ("--max-iterations", {"type": int, "default": 3}), k,
        ("--max-steps-per-iteration", {"type": int, "default": 5}), ("--max-tokens", number), ("--max-wall-clock", {"type": float}),
        ("--budget-usd", {"type": float}),
    )
    command("agent", "trace", agent_trace, "run_id")
    return top


def main(arguments: list[str] | None = None) -> int:
    try:
        options = parser().parse_args(arguments)
        app = App(options)
        logs.configure(options.log_level or app.settings.log_level, app.settings.json_logs if options.json_logs is None else options.json_logs)
        seed = app.settings.seed if options.seed is None else options.seed
        random.seed(seed)
        np.random.seed(seed)
        options.run(app)
        return 0
    except EXPECTED as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except SystemExit as stop:
        return int(stop.code or 0)
    except Exception as error:
        print(f"unexpected {type(error).__name__}: {error}", file=sys.stderr)
        return 2
