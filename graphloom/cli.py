"""Command line: python -m graphloom.cli index|search|explore|list|status|register|delete|stream|communities|probe|start ..."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from dataclasses import asdict

from graphloom.config import DEFAULTS
from graphloom.functions.jsontools import compact
from graphloom.functions.text import stopwords_of
from graphloom.plans import ingest
from graphloom.plans.search import COMMUNITIES, Engine, Tables
from graphloom.plans.tools import call, tools
from graphloom.session import get_spark
from graphloom.sources.files import read_documents, read_file, unreadable
from graphloom.sources.providers import HashEmbedding, HttpEmbedding, HttpText, ModelExtractor, RuleExtractor, healthy, probe
from graphloom.sources.registry import Registry
from graphloom.sources.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--registry")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple[str, dict], db: bool = True) -> None:
        s = sub.add_parser(name)
        if db:
            s.add_argument("database", nargs="?")
        for flag, options in flags:
            s.add_argument(flag, **options)

    yes = {"action": "store_true"}
    models = [("--service", {}), ("--model", {"default": "default"}), ("--embedding-model", {"default": "default"}), ("--width", {"type": int, "default": 64})]
    modes = {"choices": ["model", "rules"]}
    add("index", ("--source", {}), ("--file", {}), ("--extraction-mode", modes), ("--language", {"default": DEFAULTS.bm25_language}), ("--prune", yes), ("--llm-prune", yes), ("--reset", yes), ("--no-entities", yes), *models)
    add("stream", ("--source", {}), ("--checkpoint", {"required": True}), *models)
    add("search", ("--query", {"required": True}), ("--type", {"default": "connections"}), ("--language", {"default": DEFAULTS.bm25_language}), ("--lenient", yes), ("-k", {"type": int, "default": 10}), ("--alpha", {"type": float}), ("--json", yes), ("--tabular", yes), *models)
    add("explore", ("--entity", {"required": True}), ("--hops", {"type": int, "default": 1}), ("--tabular", yes))
    add("communities", *models)
    add("probe", *models, db=False)
    add("start", *models)
    add("status")
    add("list", db=False)
    add("register", ("--db-path", {}), ("--source", {"default": ""}))
    add("delete", ("--force", yes), ("--files", yes))
    return p


def _embedding(a: argparse.Namespace):
    return HttpEmbedding(a.service, a.embedding_model, a.width) if getattr(a, "service", None) else HashEmbedding(getattr(a, "width", 64))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    reg = Registry(a.registry)
    if a.command == "list":
        print("\n".join(reg.names()))
        return 0
    if a.command == "probe":
        found = probe(HttpText(a.service, a.model) if a.service else None, _embedding(a))
        print(json.dumps(found | ({"service": "ok" if healthy(a.service) else "no answer"} if a.service else {})))
        return 0 if all(v == "ok" for v in found.values()) else 1
    if a.command == "register":
        print(json.dumps(asdict(reg.register(a.database or "default", a.db_path, a.source))))
        return 0
    db = reg.get(a.database)
    if a.command == "delete":
        if not a.force:
            print("add --force to delete", file=sys.stderr)
            return 1
        if a.files:
            shutil.rmtree(db.path, ignore_errors=True)
        return 0 if reg.remove(db.name) else 1
    store = Store(get_spark(), db.path)
    if a.command == "index":
        if a.reset:
            store.reset()
        by_model = (a.extraction_mode or ("model" if a.service else "rules")) == "model"
        if by_model and not a.service:
            print("extraction by a model needs --service", file=sys.stderr)
            return 1
        extractor = None if a.no_entities else ModelExtractor(HttpText(a.service, a.model)) if by_model else RuleExtractor()
        scorer = HttpText(a.service, a.model) if a.llm_prune and a.service else None
        folder = a.source or db.source_folder
        docs = read_file(store.spark, a.file) if a.file else read_documents(store.spark, folder)
        stats = ingest.run(store, docs, _embedding(a), extractor, a.prune or a.llm_prune, scorer, stopwords=stopwords_of(a.language))
        reg.touch(db.name)
        skipped = {} if a.file or not stats.documents else {r["reason"]: r["count"] for r in unreadable(store.spark, folder).groupBy("reason").count().collect()}
        print(json.dumps(asdict(stats) | {"unreadable": skipped}))
    elif a.command == "stream":
        from graphloom.streaming.ingest import follow_folder

        follow_folder(store, a.source or db.source_folder, a.checkpoint, _embedding(a), RuleExtractor()).awaitTermination()
    elif a.command == "communities":
        ingest.community_step(store, model=HttpText(a.service, a.model) if a.service else None, embedding=_embedding(a))
    elif a.command == "start":
        own = tools(Engine(Tables.of(store), _embedding(a), strict=False), store)
        for line in sys.stdin:  # one tool call a line, one answer a line
            if line.strip():
                print(call(own, line.strip()), flush=True)
    elif a.command == "status":
        from graphloom.operators.stats import table_counts
        from graphloom.schemas import TABLES

        print(json.dumps(asdict(db) | {"tables": {r["table"]: r["rows"] for r in table_counts({t: store.read(t) for t in TABLES}).collect()}}))
    else:
        searching = a.command == "search"
        engine = Engine(Tables.of(store), _embedding(a) if searching else None, stopwords=stopwords_of(a.language) if searching else None, strict=not (searching and a.lenient))
        if not searching:
            out = engine.explore(a.entity, a.hops)
        else:
            out = engine.overview(a.query, a.k) if a.type == COMMUNITIES else engine.search(a.query, a.type, a.k, a.alpha).to_dict(a.k)
        print(compact(out) if a.tabular else json.dumps(out, default=str, indent=None if getattr(a, "json", False) else 2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
