"""Jobs: index, sections, repair, staged embedding."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import segments
from .functions import legalref
from .operators.postings import digest
from .shared import cut, drop_cut
from .sources import decision_xml, outline
from .store import Store, repaired

STAGES = ("essence", "book", "reasons")
#: Columns of the two full-text indexes (fixed values).
DECISION_INDEX = ("case_number", "headword", "keywords", "catchwords", "headnote", "title", "facts", "reasons", "orders")
SECTION_INDEX = ("section_id", "title", "breadcrumb", "body")
INDEX_FORMAT = "4"
#: Columns by which look-ups read the tables; their files are sorted by them.
CLUSTERED = {"decisions": ["id"], "decision_texts": ["id"], "decision_provisions": ["provision"], "decision_citations": ["cited_case_number"], "chunks": ["id"], "keys": ["ecli"]}
#: Decisions of a slice of decisions and of their texts, and slices of the keys.
BLOCK, KEY_SLICES = 1 << 16, 64


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def block(id: Column) -> Column:
    return F.floor(id / BLOCK)


def book_slice(source: Column) -> Column:
    return F.concat(F.lit("book-"), F.hex(source))


def sliced(name: str, rows: DataFrame) -> tuple[DataFrame, str | None]:
    """rows with the slice that each lies in, and the column that says so; None for tables without slices."""
    by = {"decisions": lambda: block(F.col("id")), "decision_texts": lambda: block(F.col("decision_id")), "keys": lambda: F.pmod(F.xxhash64("ecli"), F.lit(KEY_SLICES)), "chunks": lambda: F.col("kind")}
    return (rows.withColumn("slice", by[name]().cast("string")), "slice") if name in by else (rows, None)


def index_rows(store: Store, blocks: list | None = None, whole: bool = False) -> DataFrame:
    """Text rows with the fields of their decision, of all decisions or those of some blocks; whole: joined by hashing, so that the texts of all aren't sorted."""
    d = store.read("decisions", blocks).select(F.col("id").alias("decision_id"), "case_number", "headword", "keywords", "title")
    return store.read("decision_texts", blocks).join(d.hint("shuffle_hash") if whole else d, "decision_id")


def update_index(store: Store, name: str, rows: DataFrame, columns: tuple[str, ...]) -> None:
    """Bring a text index in step with all its rows, told apart by id and a digest of their columns; only what differs is indexed."""
    if not segments.exists(store, name):
        segments.build(store, name, rows, columns)
        return
    held = segments.live(store, name)[1].select("row_id", "digest")
    now = rows.select(F.col("id").alias("row_id"), digest(columns).alias("digest"))
    fresh = cut(now.join(held.hint("merge"), ["row_id", "digest"], "left_anti").select("row_id"))
    gone = cut(held.join(now.hint("merge"), ["row_id", "digest"], "left_anti").select("row_id"))
    if not (fresh.isEmpty() and gone.isEmpty()):
        segments.change(store, name, rows.join(fresh.select(F.col("row_id").alias("id")).hint("merge"), "id", "left_semi"), columns, None if gone.isEmpty() else gone)
    drop_cut(fresh, gone)


def rebuild_text_index(store: Store, rows: DataFrame | None = None) -> None:
    """Index all text rows anew; rows: those of index_rows() from files that the caller has, else they are joined once, for their postings and their figures."""
    if rows is not None:
        segments.build(store, "decision", rows, DECISION_INDEX)
    else:
        joined = cut(index_rows(store, whole=True).select("id", *DECISION_INDEX))
        segments.build(store, "decision", joined, DECISION_INDEX)
        drop_cut(joined)
    store.set_meta(index_format=INDEX_FORMAT)


def index(spark: SparkSession, xml: str, store_path: str, incremental: bool = False) -> Store:
    """Ingest decision XML; incremental keeps what is there and adds new keys and languages.

    The files are parsed once. An incremental run reads and writes, of what is
    there, the slices that the new documents' keys and decisions lie in.
    """
    store = Store(spark, store_path)
    seen = Observation()
    read = decision_xml.scan(spark, xml)
    docs = cut(read.observe(seen, *decision_xml.facts()))
    drop_cut(read)
    if incremental and store.exists("keys"):
        merge_documents(store, docs)
    else:
        load_documents(store, docs)
    drop_cut(docs)
    counts = {"decision_count": store.read("decisions").count(), "chunk_count": store.read("chunks").count(), "documents_parsed": seen.get["documents_parsed"]}
    version = seen.get["volume"] or xml.rpartition("/")[2].rpartition(".")[0]
    store.set_meta(indexed_at=_now(), data_version=version, decisions_xml=xml, index_format=INDEX_FORMAT, **counts)
    return store


def _last_ids(store: Store) -> dict[str, int]:
    top = lambda table: store.read(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return {"last_decision_id": top("decisions"), "last_text_id": top("decision_texts")}


def load_documents(store: Store, docs: DataFrame) -> None:
    """Write all tables of scanned documents; sections and their chunks stay."""
    for name, rows in decision_xml.tables(docs).items():
        rows, by = sliced(name, rows.drop("embedding"))
        if name == "chunks" and store.exists("chunks"):
            store.replace_slices(name, rows, by, CLUSTERED[name], gone=("essence", "reasons"))
        else:
            store.replace(name, rows, CLUSTERED[name], by)
    rebuild_text_index(store)
    store.set_meta(merging="", **_last_ids(store))


def merge_documents(store: Store, docs: DataFrame) -> None:
    """Add scanned documents whose key and language the store doesn't hold.

    Texts, references, chunks and new decisions are appended; decisions that
    documents add to are written again with their block. The keys come last of
    the tables: documents without one there haven't been added, and a run that
    finds another one interrupted drops what it left, see recover(). Keys may be
    millions in files of a few megabytes, so no join sends them to all tasks.
    """
    if store.meta().get("merging"):
        recover(store)
    last = {k: int(store.meta()[k]) for k in ("last_decision_id", "last_text_id")}
    keyed, by = sliced("keys", docs.filter("ecli is not null"))
    touched = [r[0] for r in keyed.select(by).distinct().collect()]  # at most KEY_SLICES
    keys = store.read("keys", touched)
    new = cut(keyed.drop(by).join(keys.select("ecli", "lang").hint("merge"), ["ecli", "lang"], "left_anti"))
    if new.isEmpty():
        return
    held = cut(keys.join(new.select("ecli").distinct().hint("merge"), "ecli", "left_semi").select("ecli", "decision_id").distinct())
    made = decision_xml.tables(new, held, last["last_decision_id"], last["last_text_id"])
    updates = cut(made.pop("updates"))
    store.set_meta(merging="1")
    for name in ("decision_texts", "decision_provisions", "decision_citations", "chunks", "decisions"):
        rows, by = sliced(name, made[name].drop("embedding"))
        store.append(name, rows, CLUSTERED[name], by)
    blocks = [str(r[0]) for r in held.select(block(F.col("decision_id"))).distinct().collect()]  # at most as many as the store has
    if blocks:
        store.replace_slices("decisions", decision_xml.updated(store.read("decisions", blocks), updates), "slice", CLUSTERED["decisions"])
    rows, by = sliced("keys", made["keys"])
    store.append("keys", rows, CLUSTERED["keys"], by)
    tops = {k: max(last[k], v) for k, v in _last_ids(store).items()}
    here = sorted({*blocks, *(str(b) for b in range(last["last_decision_id"] // BLOCK, tops["last_decision_id"] // BLOCK + 1))})
    texts = index_rows(store, here, whole=True).join(held.select("decision_id", F.lit(True).alias("_held")).hint("merge"), "decision_id", "left")  # held may have every decision, so it isn't sent to all
    added = F.col("id") > last["last_text_id"]
    segments.change(store, "decision", texts.filter(added | F.col("_held")).drop("_held"), DECISION_INDEX, texts.filter(~added & F.col("_held")).select(F.col("id").alias("row_id")) if blocks else None)
    store.set_meta(merging="", **tops)
    drop_cut(new, held, updates)


def recover(store: Store) -> None:
    """Drop what an interrupted merge has added of documents whose keys it didn't write, and bring the index in step."""
    keys = store.read("keys").select("decision_id", "lang").distinct()
    ids = keys.select("decision_id").distinct()
    owner = {"decisions": "id", "decision_provisions": "decision_id", "decision_citations": "citing_id"}
    for name in ("decision_texts", "chunks", *owner):
        rows = store.read(name)
        if name in owner:
            kept = rows.join(ids.withColumnRenamed("decision_id", owner[name]).hint("merge"), owner[name], "left_semi")
        else:
            kept = rows.join(keys.hint("merge"), ["decision_id", "lang"], "left_semi")
            if name == "chunks":
                kept = kept.unionByName(rows.filter("kind = 'book'"))
        store.replace(name, kept.select(*rows.columns), CLUSTERED[name], "slice" if "slice" in rows.columns else None)
    update_index(store, "decision", index_rows(store), DECISION_INDEX)
    store.set_meta(merging="", **_last_ids(store))


def index_sections(store: Store, pages: DataFrame, nodes: DataFrame, skip_present: bool = False) -> None:
    """Load sections, exchanging the slices of their sources; skip_present leaves sources that are there.

    Where chunks have vectors, their table must be there: without it the
    vectors of what is exchanged couldn't be told from the others.
    """
    if any(k.startswith("embedded_") and v for k, v in store.meta().items()) and not store.exists("vectors"):
        raise LookupError("the store had vectors, but its table of them is gone")
    made = outline.sections(pages, nodes).withColumn("slice", book_slice(F.col("source")))
    if store.exists("book_sections"):
        held = store.read("book_sections")
        if skip_present:
            made = made.join(held.select("source").distinct(), "source", "left_anti")
        top = held.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        made = cut(made.withColumn("id", F.col("id") + top))
        store.replace_slices("book_sections", made, "slice", ["id"])
    else:
        made = cut(made)
        store.replace("book_sections", made, ["id"], "slice")
    touched = [r[0] for r in made.select("slice").distinct().collect()]  # a few books
    rows = outline.section_chunks(made).drop("embedding").join(F.broadcast(made.select(F.col("id").alias("book_section_id"), "slice")), "book_section_id")
    if store.exists("chunks"):
        rows = rows.select(*store.read("chunks").columns)
        store.replace_slices("chunks", rows, "slice", ["id"], gone=touched)
    else:
        store.replace("chunks", rows, ["id"], "slice")
    update_index(store, "section", store.read("book_sections"), SECTION_INDEX)
    store.set_meta(book_section_count=store.read("book_sections").count())
    drop_cut(made)


def fix_provisions(store: Store) -> None:
    store.replace("decision_provisions", repaired(store.read("decision_provisions"), legalref.normalise_raw(F.col("raw"))), CLUSTERED["decision_provisions"])


Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """A stand-in without weights: hashed words, unit length. Prefixes ``query: `` and ``passage: `` are dropped."""

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = []
        for text in texts:
            v = np.zeros(dimensions)
            for w in text.removeprefix("passage: ").removeprefix("query: ").lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dimensions] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


class NoModel(RuntimeError):
    """The model's files are absent or can't be loaded."""


def onnx_embedder(model: str, tokenizer: str, most_tokens: int = 512) -> Embedder:
    """A sentence encoder from files: padded batches, masked mean, unit length. Loaded once a worker; a failure is remembered, absent files aren't."""
    loaded: list = []

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np

        if not loaded:
            if not (os.path.exists(model) and os.path.exists(tokenizer)):
                raise NoModel(f"no model at {model}, {tokenizer}")
            try:
                import onnxruntime
                import sentencepiece

                loaded.extend([onnxruntime.InferenceSession(model), sentencepiece.SentencePieceProcessor(model_file=tokenizer)])
            except Exception as e:
                loaded[:] = [NoModel(f"{type(e).__name__}: {e}")]
        if isinstance(loaded[0], NoModel):
            raise loaded[0]
        session, pieces = loaded
        # ids of the model: those of the pieces plus one, unknown 3, begin 0, end 2, padding 1
        rows = [[0, *[i + 1 if i else 3 for i in ids[: most_tokens - 2]], 2] for ids in pieces.encode(texts)]
        width = max(map(len, rows))
        ids = np.array([r + [1] * (width - len(r)) for r in rows], dtype=np.int64)
        mask = np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows], dtype=np.int64)
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        mean = (hidden * mask[:, :, None]).sum(1) / mask.sum(1, keepdims=True)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """chunks with vectors, by batches inside Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = ["passage: " + t for t in s]
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])], dtype=object)

    return chunks.withColumn("embedding", vectors(F.col("text")))


def _chunks_of(store: Store, kind: str) -> DataFrame:
    slices = store.slices("chunks")
    rows = store.read("chunks", [x for x in slices if x.split("-")[0] == kind] if slices else None)
    return rows.filter(F.col("kind") == kind).withColumn("digest", F.xxhash64("text"))


def chunk_vectors(store: Store, kinds: tuple[str, ...] = STAGES) -> DataFrame | None:
    """id, digest, kind and embedding of chunks; None where there are none of these kinds."""
    there = [k for k in kinds if k in store.slices("vectors")]
    return store.read("vectors", there) if there else None


def embedded_chunks(store: Store, kinds: tuple[str, ...] = STAGES) -> DataFrame | None:
    """Chunks with their vectors; a vector counts for the text that it was made of."""
    vectors = chunk_vectors(store, kinds)
    return None if vectors is None else store.read("chunks").withColumn("digest", F.xxhash64("text")).join(vectors.select("id", "digest", "embedding"), ["id", "digest"]).drop("digest")


def pending(store: Store, kind: str) -> DataFrame:
    """id and digest of the chunks of a kind that have no vector."""
    rows, vectors = _chunks_of(store, kind).select("id", "digest"), chunk_vectors(store, (kind,))
    return rows if vectors is None else rows.join(vectors.select("id", "digest"), ["id", "digest"], "left_anti")


def embed(store: Store, embedder: Embedder, model: str, stage: str | None = None, batch_rows: int = 100_000) -> None:
    """Fill missing vectors, by batches of about batch_rows chunks in the order of ids; each is committed, so a rerun makes what is missing and nothing twice."""
    if stage is not None and stage not in STAGES:
        raise ValueError(f"unknown stage {stage}; one of {', '.join(STAGES)}")
    before = store.meta().get("embedding_model")
    if before not in (None, model):
        raise ValueError(f"the store holds vectors of {before}")
    store.set_meta(embedding_model=model)
    for kind in STAGES if stage is None else (stage,):
        missing = cut(pending(store, kind))
        n = missing.count()
        batches = -(-n // batch_rows)
        bounds = missing.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
        at = F.col("id").cast("double")
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            here = F.lit(True) if low is None else at >= low
            here = here if high is None else here & (at < high)
            rows = _chunks_of(store, kind).filter(here).join(missing.filter(here), ["id", "digest"], "left_semi")
            if n:
                vectors = cut(embedded(rows.repartitionByRange("id"), embedder).select("id", "digest", "kind", "embedding"))  # a sort's sample would run the embedder again
                store.append("vectors", vectors, ["id"], "kind")
                drop_cut(vectors)
        drop_cut(missing)
        store.set_meta(**{f"embedded_{kind}_at": _now()})
    store.set_meta(embedded_at=_now())


def ensure_index_format(store: Store) -> bool:
    """Rebuild the text index if it was written by another format; whether it was."""
    if not store.is_indexed() or store.meta().get("index_format") == INDEX_FORMAT:
        return False
    rebuild_text_index(store)
    return True
