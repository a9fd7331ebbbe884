"""Readers of other stores' exports, and live sources, into (id, vector, payload)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fail(message: str | Column) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def id_text(v: Column) -> Column:
    """String or number ids as text; others are an error. ``v``: variant."""
    kind = F.schema_of_variant(v)
    ok = kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)")
    return F.when(F.coalesce(ok, F.lit(False)), F.variant_get(v, "$", "string")).otherwise(fail("an id is a string or a number"))


def parse_literal(text: Column) -> Column:
    """``"[1, 2]"`` as array<float>; ``"[]"`` is empty; a bad component is an error."""
    inner = F.trim(F.regexp_replace(F.trim(text), r"^\[|\]$", ""))
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).cast("float"))
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(parts)


def pick_vector(v: Column, name: str | None = None) -> Column:
    """array<float> of a variant: an array, a text literal, or an object of named vectors (by name, or the only one)."""
    kind = F.schema_of_variant(v)
    named = F.from_json(F.to_json(v), "map<string,array<float>>")
    if name:
        chosen = F.coalesce(F.element_at(named, name), fail(f"no vector named {name}").cast("array<float>"))
    else:
        chosen = F.when(F.size(named) == 1, F.map_values(named)[0]).otherwise(fail("several named vectors: give a name").cast("array<float>"))
    return F.when(kind.startswith("OBJECT"), chosen).when(kind == "STRING", parse_literal(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<float>")).otherwise(fail("no vector").cast("array<float>"))


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))


def read_points_jsonl(spark: SparkSession, path: str, *, vector_name: str | None = None) -> DataFrame:
    """One ``{"id", "vector", "payload"}`` object a line; blank lines are skipped."""
    part = lambda p: F.try_variant_get("v", p, "variant")
    return _json_lines(spark, path).select(id_text(part("$.id")).alias("id"), pick_vector(part("$.vector"), vector_name).alias("vector"), F.coalesce(F.to_json(part("$.payload")), F.lit("{}")).alias("payload"))


def read_rows_jsonl(spark: SparkSession, path: str, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """One table row as an object a line: the vector is an array or a text literal, all other columns are payload."""
    part = lambda p: F.try_variant_get("v", p, "variant")
    fields = F.from_json(F.to_json("v"), "map<string,variant>")
    rest = F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(id_col, vector_col)))
    return _json_lines(spark, path).select(id_text(part(f'$["{id_col}"]')).alias("id"), pick_vector(part(f'$["{vector_col}"]')).alias("vector"), rest.alias("payload"))


def read_parallel_arrays(spark: SparkSession, path: str) -> DataFrame:
    """One object of parallel arrays ids, embeddings, metadatas and documents; documents join the payload as ``document``."""
    schema = "ids array<string>, embeddings array<array<float>>, metadatas array<map<string,variant>>, documents array<string>"
    return from_parallel_arrays(spark.read.schema(schema).json(path, multiLine=True))


def from_parallel_arrays(rows: DataFrame) -> DataFrame:
    n = F.size("ids")
    same = lambda c: F.col(c).isNull() | (F.size(c) == n)
    ok = rows.withColumn("ids", F.when((F.size("embeddings") == n) & same("metadatas") & same("documents"), F.col("ids")).otherwise(fail("parallel arrays differ in length").cast("array<string>")))
    at = ok.select("embeddings", "metadatas", "documents", F.posexplode("ids").alias("i", "id"))
    doc, meta = F.get("documents", F.col("i")), F.get("metadatas", F.col("i"))
    # JSON texts are merged: metadata without its own "document", then the document
    own = F.to_json(F.map_filter(meta, lambda k, _: k != "document"))
    with_doc = F.to_json(F.struct(doc.alias("document")))
    merged = F.when(F.coalesce(own, F.lit("{}")) == "{}", with_doc).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substring(with_doc, 2, 1 << 30)))
    payload_text = F.when(doc.isNotNull(), merged).otherwise(F.coalesce(F.to_json(meta), F.lit("{}")))
    return at.select("id", F.get("embeddings", F.col("i")).alias("vector"), payload_text.alias("payload"))


def read_table(spark: SparkSession, url: str, table: str, *, id_col: str = "id", vector_col: str = "embedding", **options) -> DataFrame:
    """A database table over JDBC; the vector comes as a text literal, other columns as payload."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    rest = [c for c in rows.columns if c not in (id_col, vector_col)]
    return rows.select(F.col(id_col).cast("string").alias("id"), parse_literal(F.col(vector_col).cast("string")).alias("vector"), F.to_json(F.struct(*rest)).alias("payload"))


def infer_dim(points: DataFrame, vector_col: str = "vector") -> int:
    """The one length all vectors share."""
    r = points.agg(F.min(F.size(vector_col)).alias("lo"), F.max(F.size(vector_col)).alias("hi")).first()
    if not r["lo"] or r["lo"] != r["hi"] or r["lo"] < 0:
        raise ValueError("there are no vectors, empty ones, or several lengths")
    return r["lo"]


def import_points(catalog, name: str, points: DataFrame, spec=None) -> int:
    """Create the collection if it is new, and upsert all points as one version; their number."""
    from ..schema import CollectionSpec

    if name in catalog.names():
        c = catalog.open(name)
    else:
        c = catalog.create(name, spec or CollectionSpec(infer_dim(points), "l2"))
    before = c.manifest().segments
    done = c.upsert(points, bulk=True)
    return c._segments([s for s in done.segments if s not in before]).count()


class PagedPartition(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedSource(DataSource):
    """Pages of a live store: ``format("cairnspark_pages")`` with options url, collection, kind and batch.

    kind ``scroll``: POST {url}/collections/{collection}/points/scroll until there is no next offset.
    kind ``offset``: GET {url}/collections lists names and ids, then POST {url}/collections/{id}/get with growing offsets until a short page.
    Network access is the standard library's; ``fetch`` can be replaced for tests.
    """

    @classmethod
    def name(cls) -> str:
        return "cairnspark_pages"

    def schema(self) -> str:
        return "id string, vector array<float>, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [PagedPartition(0)]  # pages follow one another: each names the next

    def read(self, partition) -> Iterator[tuple]:
        import json
        import urllib.request

        url, name, batch = self.options["url"].rstrip("/"), self.options["collection"], int(self.options.get("batch", 256))

        def post(path: str, body: dict | None) -> dict:
            request = urllib.request.Request(f"{url}{path}", None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=60) as r:
                return json.load(r)

        yield from pages(post, self.options.get("kind", "scroll"), name, batch)


def pages(post, kind: str, name: str, batch: int = 256) -> Iterator[tuple]:
    """Points of a paged store; ``post(path, body)`` returns the decoded answer (without a body it is a GET)."""
    import json

    if kind == "scroll":
        offset = None
        while True:
            got = post(f"/collections/{name}/points/scroll", {"limit": batch, "offset": offset, "with_payload": True, "with_vector": True})["result"]
            for p in got["points"]:
                yield str(p["id"]), [float(x) for x in p["vector"]], json.dumps(p.get("payload") or {})
            offset = got.get("next_page_offset")
            if offset is None:
                return
    known = {c["name"]: c["id"] for c in post("/collections", None)}
    if name not in known:
        raise KeyError(f"the store has no collection {name}")
    at = 0
    while True:
        got = post(f"/collections/{known[name]}/get", {"limit": batch, "offset": at, "include": ["embeddings", "metadatas", "documents"]})
        for i, ident in enumerate(got["ids"]):
            payload = dict((got.get("metadatas") or [None] * len(got["ids"]))[i] or {})
            if (doc := (got.get("documents") or [None] * len(got["ids"]))[i]) is not None:
                payload["document"] = doc
            yield ident, [float(x) for x in got["embeddings"][i]], json.dumps(payload)
        if len(got["ids"]) < batch:
            return
        at += batch
