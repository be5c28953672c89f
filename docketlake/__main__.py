"""Command line: python -m docketlake index|embed|fix-provisions|smoke|search STORE ..."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession

from . import jobs
from .plans.library import Library, to_json
from .smoke import smoke
from .sources.decision_xml import newest_source
from .sources.outline import read_pdf
from .store import Store


def _books(spark: SparkSession, a: argparse.Namespace):
    """(pages, outline) of the books named, from tables or from PDF files by an extractor; none: no tables."""
    if a.pages and a.outline:
        return [(spark.read.parquet(a.pages), spark.read.parquet(a.outline))]
    module, _, function = a.extractor.partition(":")
    files = [(path, source) for path, source in ((a.clb, "clb"), (a.gl, "gl")) if path]
    extract = getattr(importlib.import_module(module), function)
    return [read_pdf(spark, path, source, extract) for path, source in files]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketlake")
    p.add_argument("command", choices=["index", "embed", "fix-provisions", "smoke", "search"])
    p.add_argument("store", nargs="?", default=os.environ.get("DOCKETLAKE_STORE"))
    p.add_argument("--source", default=os.environ.get("DOCKETLAKE_SOURCE"), help="an XML file, or a folder whose newest EPDecisions_*.xml is taken, or that of the nearest folder above")
    p.add_argument("--incremental", action="store_true", help="keep what is there; books that are there are left alone")
    p.add_argument("--books", action="store_true", help="exchange the books only")
    p.add_argument("--pages", help="Parquet table of pages (source, page, text)")
    p.add_argument("--outline", help="Parquet table of outline nodes (source, node_id, parent_id, ord, title, page)")
    p.add_argument("--clb", help="PDF file of the case law book")
    p.add_argument("--gl", help="PDF file of the guidelines")
    p.add_argument("--extractor", default="docketlake.sources.pdf:extract", help="MODULE:FUNCTION that turns a PDF file's bytes into page texts and outline nodes")
    p.add_argument("--stage", choices=jobs.STAGES)
    p.add_argument("--model")
    p.add_argument("--tokenizer")
    p.add_argument("--query", default="")
    return p


def main(arguments: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(arguments)
    if not a.store:
        p.error("name a store, or set DOCKETLAKE_STORE")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    embedder = jobs.onnx_embedder(a.model, a.tokenizer) if a.model and a.tokenizer else jobs.hashing_embedder()
    store = Store(spark, a.store)
    library = Library(store, lambda q: embedder([q])[0])
    if a.command == "index":
        if not a.books:
            xml = a.source if a.source and a.source.endswith(".xml") else newest_source(spark, a.source or ".")
            if xml is None:
                p.error("no source found")
            jobs.index(spark, xml, a.store, a.incremental)
        for pages, nodes in _books(spark, a):
            jobs.index_sections(store, pages, nodes, skip_present=a.incremental and not a.books)
    elif a.command == "embed":
        jobs.embed(store, embedder, a.model or "hashing", a.stage)
    elif a.command == "fix-provisions":
        jobs.fix_provisions(store)
    elif a.command == "smoke":
        failed = smoke(library)
        print("\n".join(failed) or "all checks passed")
        sys.exit(1 if failed else 0)
    else:
        jobs.ensure_index_format(store)
        print(to_json(library.search_decisions(a.query)))


if __name__ == "__main__":
    main()
