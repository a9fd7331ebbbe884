"""The facade: collections by name, the request verbs, limits and access checks."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import term_id  # noqa: F401  (part of the public surface)
from .operators import fusion, indexes, lexical, multivector, postings, search
from .plans.table import Catalog, Collection
from .schema import CollectionSpec, SpecError, check_limit

ROLES = {"read": 1, "write": 2, "admin": 3}


class AccessError(PermissionError):
    """The caller's role or collections do not allow the request."""


@dataclass
class Grant:
    """A role on collections; a pattern that ends in ``*`` is a prefix."""

    role: str = "admin"
    collections: tuple[str, ...] = ("*",)

    def check(self, need: str, name: str) -> None:
        known = any(name.startswith(p[:-1]) if p.endswith("*") else name == p for p in self.collections)
        if ROLES[self.role] < ROLES[need] or not known:
            raise AccessError(f"{need} on {name}")


@dataclass
class Engine:
    """Verbs over a catalog. Searches return DataFrames; nothing runs until they are used."""

    spark: SparkSession
    root: str
    grant: Grant = field(default_factory=Grant)
    audit: list[dict] = field(default_factory=list)
    #: A local file that each audit record is appended to as a JSON line, if given.
    audit_file: str | None = None

    def __post_init__(self):
        self.catalog = Catalog(self.spark, self.root)

    def _record(self, need: str, verb: str, name: str) -> None:
        """Check access and leave an audit record, whatever the outcome."""
        entry = {"at": time.time(), "actor": self.grant.role, "action": verb, "resource": name, "outcome": "ok"}
        try:
            self.grant.check(need, name)
        except AccessError:
            entry["outcome"] = "denied"
            raise
        finally:
            self.audit.append(entry)
            if self.audit_file:
                with open(self.audit_file, "a") as out:
                    out.write(json.dumps(entry) + "\n")

    def _open(self, name: str, need: str, verb: str) -> Collection:
        self._record(need, verb, name)
        return self.catalog.open(name)

    def create_collection(self, name: str, spec: CollectionSpec) -> None:
        self._record("admin", "create", name)
        self.catalog.create(name, spec)

    def drop_collection(self, name: str) -> bool:
        self._record("admin", "drop", name)
        return self.catalog.drop(name)

    #: Sealed collections keep their key beside the data, so dropping the folder destroys it.
    shred_collection = drop_collection

    def list_collections(self) -> list[str]:
        return self.catalog.names()

    def describe(self, name: str) -> dict:
        c = self._open(name, "read", "describe")
        m = c.manifest()
        return json.loads(c.spec.to_json()) | {"name": name, "count": c.count(), "version": m.version, "index_ready": indexes.ready(c)}

    def stats(self) -> DataFrame:
        return self.catalog.stats()

    def _rows(self, points) -> DataFrame:
        """A DataFrame as it is, or (id, vector, payload) tuples in order; payloads are JSON texts or objects."""
        if isinstance(points, DataFrame):
            return points
        rows = [(str(i), [float(x) for x in v], p if isinstance(p, str) or p is None else json.dumps(p), n) for n, (i, v, p) in enumerate(points)]
        return self.spark.createDataFrame(rows, "id string, vector array<float>, payload string, ord long")

    def upsert(self, name: str, points, *, bulk: bool = False):
        """Points as a DataFrame (with ``ord`` if ids repeat) or a list of (id, vector, payload), of which the last of equal ids wins."""
        c = self._open(name, "write", "upsert")
        if c.spec.multivector:
            raise SpecError("use upsert_documents on a multi-vector collection")
        if not isinstance(points, DataFrame):
            check_limit("bulk" if bulk else "batch", len(points))
            for _, _, p in points:
                check_limit("payload_bytes", len((p if isinstance(p, str) else json.dumps(p)).encode()) if p is not None else 0)
        return c.upsert(self._rows(points), bulk=bulk or not isinstance(points, DataFrame))

    def upsert_many(self, name: str, points: Iterable, batch: int = 10_000) -> int:
        """Points of any iterator, a version for each batch of them; their number."""
        source, total = iter(points), 0
        while part := list(itertools.islice(source, check_limit("bulk", batch))):
            self.upsert(name, part, bulk=True)
            total += len(part)
        return total

    def upsert_text(self, name: str, rows: DataFrame):
        """(id, text[, payload][, ord]): embed with the collection's provider; the payload keeps the text, unless it has a ``text`` of its own."""
        c = self._open(name, "write", "upsert_text")
        embed = fusion.PROVIDERS[name]["embedder"]
        payload = F.to_json(F.struct("text"))
        if "payload" in rows.columns:
            own = F.try_variant_get(F.parse_json("payload"), "$", "map<string,variant>")
            text = F.create_map(F.lit("text"), F.col("text").cast("variant"))
            payload = F.when(own.isNull(), payload).when(F.map_contains_key(own, "text"), F.col("payload")).otherwise(F.to_json(F.map_concat(own, text)))
        ready = rows.select("id", fusion.embed_column(F.col("text"), embed, c.spec.dim).alias("vector"), payload.alias("payload"), *(["ord"] if "ord" in rows.columns else []))
        return c.upsert(ready, bulk=True)

    def upsert_documents(self, name: str, docs: DataFrame):
        """(doc_id, vectors, payload): token rows; tokens of an older, longer version go in the same commit."""
        c = self._open(name, "write", "upsert_documents")
        if not c.spec.multivector:
            raise SpecError("this collection has one vector a point")
        tokens = multivector.to_tokens(docs).withColumn("id", multivector.token_id(F.col("doc_id"), F.col("ordinal")))
        old = self._tokens(c).join(docs.select("doc_id"), "doc_id", "left_semi").select("id")
        return c.apply(upserts=tokens.select("id", "vector", "payload"), deletes=old, action="upsert_documents")

    def _tokens(self, c: Collection, tree=None) -> DataFrame:
        return c.where(tree).withColumn("_t", multivector.parse_token_id(F.col("id"))).select("id", "_t.*", "vector", "payload")

    def get_document(self, name: str, doc_id: str) -> DataFrame:
        rows = self._tokens(self._open(name, "read", "get_document")).where(F.col("doc_id") == doc_id)
        return multivector.gather(rows).join(rows.where("ordinal = 0").select("doc_id", "payload"), "doc_id", "left")

    def delete_document(self, name: str, doc_id: str) -> bool:
        c = self._open(name, "write", "delete_document")
        return c.delete(self._tokens(c).where(F.col("doc_id") == doc_id).select("id")) > 0

    def document_count(self, name: str) -> int:
        return multivector.document_count(self._tokens(self._open(name, "read", "document_count"))).first()["documents"]

    def delete(self, name: str, ids: Sequence[str]) -> int:
        return self._open(name, "write", "delete").delete(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_by_filter(self, name: str, tree) -> int:
        return self._open(name, "write", "delete_by_filter").delete_where(tree)

    def get(self, name: str, ident: str) -> DataFrame:
        return search.get(self._open(name, "read", "get").snapshot(), ident)

    def get_many(self, name: str, ids: Sequence[str]) -> DataFrame:
        return search.multi_get(self._open(name, "read", "get_many").snapshot(), ids)

    def count(self, name: str) -> int:
        return self._open(name, "read", "count").count()

    def fetch(self, name: str, tree=None, *, offset: int = 0, limit: int = 100, with_payload: bool = True, with_vector: bool = False) -> DataFrame:
        rows = self._open(name, "read", "fetch").where(tree).orderBy("id").offset(offset).limit(check_limit("fetch", limit))
        return self._shown(rows.withColumn("score", F.lit(0.0)), with_payload, with_vector)

    @staticmethod
    def _shown(rows: DataFrame, with_payload: bool, with_vector: bool) -> DataFrame:
        return rows.select("id", "score", *(["payload"] if with_payload else []), *(["vector"] if with_vector else []))

    def build_index(self, name: str, **options) -> dict:
        """Build or rebuild the index that the specification's kind asks for, over the newest version."""
        return indexes.build(self._open(name, "write", "build_index"), **options)

    def search(self, name: str, vector: Sequence[float], k: int = 10, *, tree=None, with_payload: bool = True, with_vector: bool = False, version: int | None = None, ef: int | None = None, exact: bool = False) -> DataFrame:
        """The k nearest points: by the collection's index where one is ready and the plan is worth it, else exactly.

        ``ef``: how many candidates an index looks at; a filter, a version or ``exact`` asks for the exact scan.
        """
        c = self._open(name, "read", "search")
        if c.spec.vector_encryption == "client_side" or c.spec.multivector:
            raise SpecError("this collection is not searched by one vector")
        if len(vector) != c.spec.dim:
            raise SpecError(f"the query has not {c.spec.dim} components")
        check_limit("k", k)
        if ef is not None:
            check_limit("ef", ef)
        found = indexes.search(c, vector, k, tree=tree, version=version, ef=ef, exact=exact)
        return self._shown(found, with_payload, with_vector)

    def search_documents(self, name: str, query: Sequence[Sequence[float]], k: int = 10, *, tree=None) -> DataFrame:
        """Documents by MaxSim; the filter reads the payload on a document's first token."""
        c = self._open(name, "read", "search_documents")
        if not c.spec.multivector:
            raise SpecError("this collection has one vector a point")
        tokens = self._tokens(c)
        if tree is not None:
            tokens = tokens.join(self._tokens(c, tree).where("ordinal = 0").select("doc_id"), "doc_id", "left_semi")
        return multivector.search(tokens, query, k, metric=c.spec.metric)

    @staticmethod
    def _texts(rows: DataFrame) -> DataFrame:
        return rows.withColumn("text", F.get_json_object("payload", "$.text"))

    def hybrid(self, name: str, k: int = 10, *, vector=None, sparse: Mapping[int, float] | None = None, text: str | None = None, tree=None) -> DataFrame:
        """Ranks of a vector, a sparse vector (weights by term id) and a text fused; at least one is given.

        Sparse weights of a point are its payload's ``sparse`` (indices and values), else the term ids of its ``text``.
        Statistics and weights come from the collection's stored postings where these are of the newest version.
        """
        c = self._open(name, "read", "hybrid")
        depth, lists = max(10 * k, 100), []
        allowed = c.where(tree).select("id") if tree is not None else None
        keep = lambda s: s if allowed is None else s.join(allowed, "id", "left_semi")
        if vector is not None:
            lists.append(fusion.ranked_list(search.knn(c.where(tree), vector, depth, metric=c.spec.metric), depth, descending=c.spec.metric != "l2"))
        if sparse is not None:
            check_limit("sparse_terms", len(sparse))
            lists.append(fusion.ranked_list(keep(lexical.sparse_scores(self._weights(c), sparse)), depth))
        if text is not None:
            terms = lexical.analyse(self.spark, text, stem=True)
            stored = postings.of(c)
            scores = stored.bm25(terms) if stored else lexical.bm25_scores(lexical.postings_from_text(self._texts(c.snapshot()), stem=True), terms)
            lists.append(fusion.ranked_list(keep(scores), depth))
        if not lists:
            raise SpecError("give a vector, a sparse vector or a text")
        return fusion.rrf(lists, k)

    def _weights(self, c: Collection) -> DataFrame:
        """(id, term, weight) by term id, of explicit sparse vectors or texts."""
        given = F.from_json("payload", "struct<sparse:struct<indices:array<bigint>,values:array<float>>,text:string>")
        rows = c.snapshot().select("id", given.alias("p")).select("id", "p.sparse.indices", "p.sparse.values", "p.text")
        return lexical.extract_postings(rows, stem=True)

    def index_text(self, name: str) -> None:
        """Store the postings of the newest version, or bring them up to it."""
        postings.refresh(self._open(name, "write", "index_text"))

    def search_text(self, name: str, query: str, k: int = 10, *, tree=None, rerank: bool = False) -> DataFrame:
        provider = fusion.PROVIDERS[name]
        found = self.hybrid(name, max(k, 50) if rerank else k, vector=provider["embedder"]([query])[0], text=query, tree=tree)
        if not rerank:
            return found
        rows = self._texts(self.catalog.open(name).snapshot()).select("id", fusion.rerank_text(F.col("text"), F.col("payload")).alias("text"))
        pool = search.ranked(found, max(k, 50), F.desc("score"), F.col("id")).join(rows, "id")
        return fusion.rerank_with(pool, query, provider["reranker"], k)

    def backup(self, name: str, dest: str) -> dict:
        return self._open(name, "admin", "backup").backup(dest)

    def restore(self, source: str, name: str) -> Collection:
        self._record("admin", "restore", name)
        return Collection.restore(self.spark, source, f"{self.root}/{name}")


class VectorStore:
    """Duck-typed text store for application frameworks: add_texts, similarity_search, delete."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name = engine, name

    def add_texts(self, texts: Sequence[str], ids: Sequence[str] | None = None) -> list[str]:
        import uuid

        ids = list(ids or (uuid.uuid4().hex for _ in texts))
        self.engine.upsert_text(self.name, self.engine.spark.createDataFrame(list(zip(ids, texts)), "id string, text string"))
        return ids

    def similarity_search_with_score(self, query: str, k: int = 4, *, hybrid: bool = False) -> list[tuple[str, str, float]]:
        if hybrid:
            found, larger_is_nearer = self.engine.search_text(self.name, query, k), True
        else:
            found = self.engine.search(self.name, fusion.PROVIDERS[self.name]["embedder"]([query])[0], k, with_payload=False)
            larger_is_nearer = self.engine.catalog.open(self.name).spec.metric != "l2"
        texts = self.engine._texts(self.engine.catalog.open(self.name).snapshot()).select("id", "text")
        rows = found.select("id", "score").join(texts, "id").collect()  # k rows
        return [(r["id"], r["text"], r["score"]) for r in sorted(rows, key=lambda r: (-r["score"] if larger_is_nearer else r["score"], r["id"]))]

    def similarity_search(self, query: str, k: int = 4, **options) -> list[str]:
        return [t for _, t, _ in self.similarity_search_with_score(query, k, **options)]

    def delete(self, ids: Sequence[str]) -> int:
        return self.engine.delete(self.name, ids)
