"""A durable catalogue on immutable files: segments, dead rows, an event log and versioned manifests.

Every change writes new Parquet folders and then one manifest, ``manifests/<n>.json``: the state is
what the highest manifest names, and a failed change leaves unreferenced files behind but never a
half state. Changes are optimistic: what takes long (parsing, embedding, writing files) happens
without a lock; then the newest manifest is read, the change is tested again on what is new in it,
and the next one is published if no other writer has been first, else all this is repeated for
`BUSY_SECONDS`. A manifest appears by a hard link on local files, elsewhere by a rename behind a
marker that only one writer can create, so writers may be threads or processes.

A segment holds products, field vectors, product vectors and identifiers, each in folders by hashed
number (`BUCKET_ROWS` rows each), with the row's place in the segment. The manifest has what tells
whether a segment can matter: its numbers if they are few, else the folder by hash and a Bloom filter
in its files; its categories; its manufacturers, or their trigrams. Deleting marks rows as dead in
the manifest, which is a filter at the scan. After `COMPACT_SEGMENTS` segments or `COMPACT_DEAD` dead
rows the live rows are written together again; `vacuum` removes what no version in use names.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import parse
from shelfmark.functions.text import _fold, casefold, fold, quoted, sku_form, squash
from shelfmark.functions.vocabulary import CATEGORY_LABELS
from shelfmark.operators import search as ranking
from shelfmark.operators import vectors as embedding
from shelfmark.operators.enrich import ENRICHMENT
from shelfmark.operators.resolve import identifiers
from shelfmark.plans.catalogue import Catalogue

# What a store of this format says of itself, and how long a writer waits (seconds).
SCHEMA_VERSION, SCHEMA_ID = "1", "shelfmark-catalogue"
BUSY_SECONDS = 5.0

KINDS = ("products", "fields", "vectors", "identifiers")
BUCKET_ROWS = 250_000
COMPACT_SEGMENTS, COMPACT_DEAD, COMPACT_EVENTS = 32, 10_000, 256
#: What the manifest lists of a segment at most: numbers, manufacturers, trigrams of manufacturers.
NUMBERS, MANUFACTURERS, TRIGRAMS = 64, 200, 5_000
#: After this a marker without its manifest is of a writer that died.
CLAIM_SECONDS = 60.0
_IDENTIFIERS = "sku string, kind string, canonical_sku string, home int, row bigint"
_turns: dict[str, threading.Lock] = {}


class ProductConflict(ValueError):
    """The number already names a product."""


class ProductNotFound(LookupError):
    """The number names no product."""


class InvalidProduct(ValueError):
    """The input lacks something or is outside the vocabulary."""


class ConcurrentWrite(RuntimeError):
    """Other writers were first for as long as a writer waits; nothing of this change is visible."""


@dataclass(frozen=True)
class ProductInput:
    sku: str
    name: str
    manufacturer: str
    category: str | None = None
    package: str = ""
    price: str = ""
    attributes: str = ""
    description: str = ""
    applications: str = ""


@dataclass(frozen=True)
class DeletedProduct:
    canonical_sku: str
    alias_skus: list[str]


def _json(value) -> str:
    """Compact, with non-ASCII characters as they are; decimals as texts."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def can_pass(segment: dict, manufacturer: str | None, category: str | None) -> bool:
    """Whether a segment can have a product that passes the filters (normalized, or None)."""
    if category and category not in segment["categories"]:
        return False
    if manufacturer and segment["manufacturers"] is not None:
        return any(manufacturer in m for m in segment["manufacturers"])
    return not manufacturer or segment["trigrams"] is None or _trigrams(manufacturer) <= set(segment["trigrams"])


class Snapshot:
    """One version of the store: what its manifest names, whatever is published meanwhile."""

    def __init__(self, store: CatalogueStore, version: int, state: dict):
        self.store, self.version, self.state = store, version, state

    def table(self, kind: str, wanted: Callable[[dict], bool] = lambda segment: True) -> DataFrame | None:
        """The live rows of the wanted segments: a filter at the scan, no exchange. None if there is no segment at all."""
        segments = self.state["segments"]
        if not segments:
            return None
        some = [s for s in segments if wanted(s)]
        if not some:
            return self.store._load([segments[0][kind]]).filter("false")
        whole = [s[kind] for s in some if not s["dead"]]
        parts = [self.store._load(whole)] if whole else []
        parts += [self.store._load([s[kind]]).filter(_alive(s["dead"])) for s in some if s["dead"]]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def products(self) -> DataFrame | None:
        table = self.table("products")
        return table.drop("row") if table is not None else None

    def find(self, number: str, seen: frozenset[str] = frozenset()) -> Row | None:
        """sku, kind, canonical_sku, home, row and segment of what `number` names; segments in `seen` are left out.

        Opens a segment's files only where its numbers or the folder of the number's hash allow it.
        """
        hashed = self.store._one(F.xxhash64(F.lit(number)))
        for segment in reversed(self.state["segments"]):
            if segment["products"] in seen or (segment["numbers"] is not None and number not in segment["numbers"]):
                continue
            folder = f"{segment['identifiers']}/bucket={hashed % segment['buckets']}"
            if not self.store._exists(folder):
                continue
            table = self.store.spark.read.schema(_IDENTIFIERS).parquet(f"{self.store.path}/{folder}")
            for hit in table.filter(F.col("sku") == number).collect():
                if hit["row"] not in segment["dead"]:
                    return Row(**hit.asDict(), segment=segment["products"])
        return None

    def product(self, hit: Row) -> DataFrame:
        """The one product of a hit, from the folder it lives in."""
        folder = f"{hit['segment']}/bucket={hit['home']}"
        return self.store._load([folder]).filter(F.col("row") == hit["row"])


def _alive(dead: list[int]):
    return F.expr(f"row NOT IN ({', '.join(str(int(r)) for r in dead)})")


class CatalogueStore:
    def __init__(self, spark: SparkSession, path: str, embedder: embedding.Embedder | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or embedding.HashedNgramEmbedder()
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        expected = {
            "schema_version": SCHEMA_VERSION,
            "schema_id": SCHEMA_ID,
            "embedding_model": self.embedder.model_name,
            "embedding_recipe": embedding.RECIPE,
        }
        if not self._versions():
            if any(name not in ("manifests", "model") for name, _ in self._names("")):
                raise RuntimeError("the folder has files but no manifest")
            try:
                self._publish(0, expected | {"seeded": False, "dimensions": None, "segments": [], "events": []})
            except ConcurrentWrite:  # another opened it first
                pass
        state = self._state()[1]
        for key, value in expected.items():
            if state.get(key) != value:
                raise RuntimeError(f"store has {key} {state.get(key)!r}, expected {value!r}")

    @staticmethod
    def has_model(spark: SparkSession, path: str) -> bool:
        """Whether the folder `model` of the store at `path` is written."""
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/model/_SUCCESS")
        return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)

    # -- manifests and files -------------------------------------------------------------------

    def _exists(self, name: str = "") -> bool:
        return self._fs.exists(self._jvm_path(f"{self.path}/{name}".rstrip("/")))

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder of the store and when they were last changed (seconds)."""
        if not self._exists(folder):
            return []
        listed = self._fs.listStatus(self._jvm_path(f"{self.path}/{folder}"))
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in listed]

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._jvm_path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool = False) -> None:
        out = self._fs.create(self._jvm_path(f"{self.path}/{name}"), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _remove(self, name: str) -> None:
        self._fs.delete(self._jvm_path(f"{self.path}/{name}"), True)

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        version = self._versions()[-1] if version is None else version
        return version, json.loads(self._text(f"manifests/{version:010d}.json"))

    def _publish(self, version: int, state: dict) -> None:
        """Make version `version`, if nobody has: one step that only one of several writers can do."""
        name, draft = f"manifests/{version:010d}.json", f"manifests/.draft-{uuid.uuid4().hex}"
        self._put(draft, _json(state))
        try:
            done = self._link(draft, name) if self._fs.getUri().getScheme() == "file" else self._claim(draft, name)
        finally:
            if self._exists(draft):
                self._remove(draft)
        if not done:
            raise ConcurrentWrite(f"version {version} was published by another writer")

    def _link(self, draft: str, name: str) -> bool:
        local = lambda n: self.spark._jvm.java.io.File(self._jvm_path(f"{self.path}/{n}").toUri().getPath()).toPath()
        try:
            self.spark._jvm.java.nio.file.Files.createLink(local(name), local(draft))
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def _claim(self, draft: str, name: str) -> bool:
        marker = f"{name.replace('.json', '.claim')}"
        try:
            self._put(marker, "")
        except Py4JJavaError:
            age = [time.time() - changed for n, changed in self._names("manifests") if marker.endswith(n)]
            if age and age[0] > CLAIM_SECONDS and not self._exists(name):
                self._remove(marker)
            return False
        try:
            target = self._jvm_path(f"{self.path}/{name}")
            return not self._fs.exists(target) and self._fs.rename(self._jvm_path(f"{self.path}/{draft}"), target)
        finally:
            self._remove(marker)

    def _commit(self, rebase: Callable[[dict], dict | None]) -> dict:
        """Publish what `rebase` makes of the newest state (None: nothing), again and again while others are first."""
        until = time.monotonic() + BUSY_SECONDS
        turn = _turns.setdefault(self.path, threading.Lock())
        if not turn.acquire(timeout=BUSY_SECONDS):
            raise ConcurrentWrite("other writers of this process take too long")
        try:
            while True:
                version, state = self._state()
                after = rebase(state)
                if after is None:
                    return state
                try:
                    self._publish(version + 1, after)
                    return after
                except ConcurrentWrite:
                    if time.monotonic() > until:
                        raise
                    time.sleep(random.uniform(0.005, 0.05))
        finally:
            turn.release()

    def _save(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _save_buckets(self, df: DataFrame, kind: str, buckets: int, order: str) -> str:
        """A folder for each value of `bucket`, rows in order; the files have Bloom filters of their numbers."""
        name = f"{kind}/{uuid.uuid4().hex}"
        writer = df.repartition(buckets, "bucket").sortWithinPartitions("bucket", order).write.partitionBy("bucket")
        if kind == "identifiers":
            writer = writer.options(**{"parquet.bloom.filter.enabled#sku": "true", "parquet.bloom.filter.expected.ndv#sku": str(BUCKET_ROWS)})
        writer.parquet(f"{self.path}/{name}")
        if not any(n.startswith("bucket=") for n, _ in self._names(name)):
            df.drop("bucket").limit(0).write.parquet(f"{self.path}/{name}/bucket=0")
        return name

    def _load(self, names: list[str]) -> DataFrame:
        """Folders of one kind; of a bucketed kind all buckets, or the one that is named."""
        bucketed = lambda n: n.partition("/")[0] in KINDS and "/bucket=" not in n
        return self.spark.read.parquet(*[f"{self.path}/{n}{'/bucket=*' if bucketed(n) else ''}" for n in names])

    # -- current state -----------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self._state())

    @contextmanager
    def reading(self, seconds: float = 3600.0) -> Iterator[Snapshot]:
        """The newest version, kept from `vacuum` until the end of the block, at most for `seconds`."""
        lease = f"leases/{uuid.uuid4().hex}.json"
        while True:
            version, state = self._state()
            self._put(lease, _json({"version": version, "until": time.time() + seconds}), overwrite=True)
            if self._exists(f"manifests/{version:010d}.json"):  # else it was vacuumed before the lease stood
                break
        try:
            yield Snapshot(self, version, state)
        finally:
            self._remove(lease)

    def products(self) -> DataFrame | None:
        """The products now: all segments without the deleted; None before anything was written."""
        return self.snapshot().products()

    @property
    def seeded(self) -> bool:
        return self._state()[1]["seeded"]

    def count_products(self) -> int:
        """From the manifest: rows written less rows dead."""
        return sum(s["rows"] - len(s["dead"]) for s in self._state()[1]["segments"])

    def identifiers(self) -> DataFrame | None:
        """sku, kind and canonical_sku of every number that names a product now."""
        table = self.snapshot().table("identifiers")
        return table.select("sku", "kind", "canonical_sku") if table is not None else None

    def product_vectors(self) -> DataFrame | None:
        table = self.snapshot().table("vectors")
        return table.drop("row") if table is not None else None

    def field_vectors(self) -> DataFrame | None:
        table = self.snapshot().table("fields")
        return table.drop("row") if table is not None else None

    def records(self) -> DataFrame | None:
        """The normalized rows that were seeded, for lineage."""
        name = self._state()[1].get("records")
        return self._load([name]) if name else None

    def candidates(self) -> DataFrame | None:
        """Cards that matched no product when the store was seeded."""
        name = self._state()[1].get("candidates")
        return self._load([name]) if name else None

    def metadata(self) -> dict:
        """What the store was made with: versions, model, recipe, dimension, and whether it was seeded."""
        state = self._state()[1]
        keys = ("schema_version", "schema_id", "embedding_model", "embedding_recipe", "dimensions", "seeded")
        return {k: state[k] for k in keys}

    def events(self) -> DataFrame | None:
        names = self._state()[1]["events"]
        return self._load(names) if names else None

    # -- changes -----------------------------------------------------------------------------

    def _segment(self, products: DataFrame, kind: str, rows: int | None = None) -> tuple[dict, int | None]:
        """Write products, what is searched of them and their numbers; the segment's entry, and its vectors' dimension.

        `rows`: how many products there are, if that is known; else they are written once more, to be counted.
        """
        stored = products.withColumns(
            {
                "product_id": F.expr("uuid()"),
                "manufacturer_folded": fold(F.col("manufacturer")),
                "source_kind": F.lit(kind),
                "created_at": F.lit(_now()),
                "row": F.monotonically_increasing_id(),
            }
        )
        return self._indexed(stored, rows)

    def _indexed(self, table: DataFrame, rows: int | None = None) -> tuple[dict, int | None]:
        draft = self._save(table, "drafts") if rows is None else None
        table = self._load([draft]) if draft else table
        rows = table.count() if rows is None else rows
        buckets = max(1, -(-rows // BUCKET_ROWS))
        hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
        segment = {"products": self._save_buckets(table.withColumn("bucket", hashed("canonical_sku")), "products", buckets, "row")}
        stored = self._load([segment["products"]])
        places = stored.select("canonical_sku", "product_id", "row", hashed("canonical_sku").alias("bucket"))
        fields = embedding.embed_fields(embedding.searchable_fields(stored), self.embedder).join(places, "canonical_sku")
        segment["fields"] = self._save_buckets(fields, "fields", buckets, "row")
        mean = embedding.product_vectors(self._load([segment["fields"]])).join(places, "canonical_sku")
        segment["vectors"] = self._save_buckets(mean, "vectors", buckets, "row")
        named = identifiers(stored.select("canonical_sku", "alias_skus")).join(places.drop("product_id"), "canonical_sku")
        named = named.select("sku", "kind", "canonical_sku", F.col("bucket").alias("home"), "row", hashed("sku").alias("bucket"))
        segment["identifiers"] = self._save_buckets(named, "identifiers", buckets, "sku")
        if draft:
            self._remove(draft)
        some = lambda df, n: [r[0] for r in df.distinct().limit(n + 1).collect()]
        told = stored.select("canonical_sku", "alias_skus", "manufacturer_folded", "category")
        few = told.collect() if rows <= NUMBERS else None
        if few is not None:  # one job for all that the manifest tells
            numbers = sorted({n for r in few for n in (r["canonical_sku"], *r["alias_skus"])})
            makers, categories = ({r[c] for r in few if r[c] is not None} for c in ("manufacturer_folded", "category"))
        else:
            numbers = some(self._load([segment["identifiers"]]).select("sku"), NUMBERS)
            makers = some(told.select("manufacturer_folded").filter("manufacturer_folded IS NOT NULL"), MANUFACTURERS)
            categories = some(told.select("category").filter("category IS NOT NULL"), 1_000)
        grams = None
        if len(makers) > MANUFACTURERS:
            places = F.expr("transform(sequence(1, length(manufacturer_folded) - 2), i -> substring(manufacturer_folded, i, 3))")
            grams = some(told.filter("length(manufacturer_folded) > 2").select(F.explode(places)), TRIGRAMS)
        dims = self._load([segment["vectors"]]).agg(F.min("dims"), F.max("dims")).collect()[0]
        if dims[0] != dims[1]:
            raise RuntimeError(f"embeddings have {dims[0]} to {dims[1]} dimensions")
        return segment | {
            "rows": rows,
            "buckets": buckets,
            "dead": [],
            "numbers": sorted(numbers) if len(numbers) <= NUMBERS else None,
            "categories": sorted(categories),
            "manufacturers": sorted(makers) if len(makers) <= MANUFACTURERS else None,
            "trigrams": sorted(grams) if grams is not None and len(grams) <= TRIGRAMS else None,
        }, dims[0]

    def _event(self, action: str, sku: str | None, payload: dict) -> str:
        row = [(action, sku, _now(), _json(payload))]
        return self._save(self.spark.createDataFrame(row, "action string, canonical_sku string, occurred_at string, payload_json string"), "events")

    @staticmethod
    def _with_dimension(state: dict, dims: int | None) -> dict:
        """The state with the dimension of a segment's vectors, which must be the store's own."""
        if dims is not None and state["dimensions"] not in (None, dims):
            raise RuntimeError(f"store uses {state['dimensions']}-dimensional embeddings, got {dims} dimensions")
        return state | {"dimensions": state["dimensions"] if dims is None else dims}

    def seed(self, catalogue: Catalogue | Callable[[Callable], Catalogue]) -> None:
        """Bulk load, exactly once: a store that was ever seeded stays as it is, even emptied.

        `catalogue` may be a function that builds one, given how to save a step (a table, and its
        kind): then each step is written before the next reads it, and nothing is computed twice.
        """
        if self.seeded:
            return
        saved: dict[str, str] = {}

        def save(df: DataFrame, kind: str) -> DataFrame:
            saved[kind] = self._save(df, kind)
            return self._load([saved[kind]])

        if callable(catalogue):
            catalogue = catalogue(save)
        records = saved.get("records") or self._save(catalogue.records, "records")
        segment, dims = self._segment(catalogue.products, "seed")
        candidates = self._save(catalogue.external_candidates, "candidates")
        event = self._event("seed", None, {"products": segment["rows"]})
        for kind, name in saved.items():
            if kind != "records":
                self._remove(name)

        def rebase(state: dict) -> dict | None:
            if state["seeded"]:
                return None
            state = self._with_dimension(state, dims)
            more = {"segments": [*state["segments"], segment], "events": [*state["events"], event]}
            return state | more | {"records": records, "candidates": candidates, "seeded": True}

        self._commit(rebase)

    def add(self, data: ProductInput) -> Row:
        """One product at run time: parsed like a row, never merged with others."""
        product = self._runtime_product(data)
        row = product.collect()[0]
        number = row["canonical_sku"]
        before = self.snapshot()
        seen = frozenset()

        def free(snapshot: Snapshot) -> None:
            if snapshot.find(number, seen):
                raise ProductConflict(f"SKU {number} already exists")

        free(before)
        self._with_dimension(before.state, len(self.embedder.embed([row["name"]])[0]))
        seen = frozenset(s["products"] for s in before.state["segments"])
        segment, dims = self._segment(self.spark.createDataFrame([row], product.schema), "runtime", rows=1)
        event = self._event("add", number, row.asDict(recursive=True))

        def rebase(state: dict) -> dict:
            free(Snapshot(self, -1, state))  # what others have added meanwhile
            state = self._with_dimension(state, dims)
            return state | {"segments": [*state["segments"], segment], "events": [*state["events"], event]}

        self._compact(self._commit(rebase))
        return row

    def delete(self, sku: str) -> DeletedProduct:
        """Remove a product by its number or an alias; the event keeps the whole product."""
        normal = self._one(sku_form(F.lit(sku)))
        before = self.snapshot()
        hit = before.find(normal)
        if not hit:
            raise ProductNotFound(f"SKU {normal} does not exist")
        row = before.product(hit).drop("row").collect()[0]
        gone = DeletedProduct(row["canonical_sku"], sorted(row["alias_skus"]))
        event = self._event("delete", gone.canonical_sku, {"deleted": asdict(gone), "product": row.asDict(recursive=True)})

        def rebase(state: dict) -> dict:
            now = Snapshot(self, -1, state)
            still = [s for s in state["segments"] if s["products"] == hit["segment"]]
            alive = hit if still and hit["row"] not in still[0]["dead"] else None
            if not still:  # it was compacted meanwhile
                alive = now.find(gone.canonical_sku)
                if alive and now.product(alive).select("product_id").collect()[0][0] != row["product_id"]:
                    alive = None
            if not alive:
                raise ProductNotFound(f"SKU {normal} does not exist")
            segments = [s | {"dead": sorted([*s["dead"], alive["row"]])} if s["products"] == alive["segment"] else s for s in state["segments"]]
            return state | {"segments": segments, "events": [*state["events"], event]}

        self._compact(self._commit(rebase))
        return gone

    def _compact(self, state: dict) -> None:
        """Write the live rows together where the manifest has many segments, dead rows or events.

        Given up if a row of theirs has died meanwhile; a later change tries again. Old files stay
        for readers of old versions until `vacuum`.
        """
        old, events = state["segments"], state["events"]
        many = len(old) > COMPACT_SEGMENTS or sum(len(s["dead"]) for s in old) > COMPACT_DEAD
        if not many and len(events) <= COMPACT_EVENTS:
            return
        told = self._save(self._load(events).repartition(1), "events") if len(events) > COMPACT_EVENTS else None
        fresh = []
        if many:
            live = Snapshot(self, -1, state).table("products").withColumn("row", F.monotonically_increasing_id())
            fresh = [self._indexed(live)[0]]

        def rebase(now: dict) -> dict | None:
            out = now
            if told and now["events"][: len(events)] == events:
                out = out | {"events": [told, *now["events"][len(events) :]]}
            if fresh and now["segments"][: len(old)] == old:
                out = out | {"segments": fresh + now["segments"][len(old) :]}
            return out if out is not now else None

        self._commit(rebase)

    def vacuum(self, keep_versions: int = 10, older_than: float = 86_400.0) -> list[str]:
        """Delete what neither the newest versions nor a reader's lease name; returns the names.

        Files changed in the last `older_than` seconds stay, for a writer may be about to name them.
        """
        old = time.time() - older_than
        leased = set()
        for name, _ in self._names("leases"):
            if name.endswith(".json") and not name.startswith("."):
                lease = json.loads(self._text(f"leases/{name}"))
                if lease["until"] < time.time():
                    self._remove(f"leases/{name}")
                else:
                    leased.add(lease["version"])
        versions = self._versions()
        kept = {v for v in versions if v in leased} | set(versions[-max(1, keep_versions) :])
        named = set()
        for version in kept:
            state = self._state(version)[1]
            named |= {s[k] for s in state["segments"] for k in KINDS} | set(state["events"])
            named |= {state[k] for k in ("records", "candidates") if state.get(k)}
        changed = dict(self._names("manifests"))
        gone = [f"manifests/{v:010d}.json" for v in versions if v not in kept and changed.get(f"{v:010d}.json", old) <= old]
        for kind, _ in self._names(""):
            if kind not in ("manifests", "leases", "model"):
                gone += [f"{kind}/{n}" for n, at in self._names(kind) if f"{kind}/{n}" not in named and at <= old]
        for name in gone:  # manifests first: a version is never without its files
            self._remove(name)
        return gone

    def _one(self, column):
        """The value of a constant expression; it needs no job."""
        return self.spark.sql("SELECT 1").select(column).collect()[0][0]

    def _runtime_product(self, data: ProductInput) -> DataFrame:
        raw = self.spark.createDataFrame([Row(**asdict(data) | {"category": data.category or ""})])
        raw = raw.withColumns({c: F.coalesce(c, F.lit("")) for c in raw.columns})
        staged = raw.select(
            sku_form(F.col("sku")).alias("canonical_sku"),
            squash(F.col("name")).alias("name"),
            squash(F.col("manufacturer")).alias("manufacturer"),
            parse.blank_to_null(F.upper(squash(F.col("category")))).alias("category"),
            F.lit("runtime").alias("category_source"),
            parse.package_of(F.col("package"), casefold(squash(F.col("package")))).alias("package"),
            parse.price_of(F.col("price")).alias("price"),
            parse.attributes_of(F.col("attributes"), casefold(squash(F.col("attributes")))).alias("attributes"),
            squash(F.col("description")).alias("description"),
            squash(F.col("applications")).alias("applications"),
        )
        row = staged.collect()[0]
        if not (row["canonical_sku"] and row["name"] and row["manufacturer"]):
            raise InvalidProduct("sku, name and manufacturer must not be empty")
        if row["category"] is not None and row["category"] not in CATEGORY_LABELS:
            raise InvalidProduct(f"unknown category {data.category!r}")
        package, price = F.col("package.raw"), F.col("price.raw")
        texts = F.array().cast("array<string>")
        card = F.struct(
            F.col("canonical_sku").alias("source_sku"),
            F.col("name"),
            "description",
            F.lit("").alias("storage"),
            "applications",
            F.lit("runtime_input").alias("match_rule"),
        ).cast(ENRICHMENT)
        told = (F.col("description") != "") | (F.col("applications") != "")
        return staged.select(
            "canonical_sku",
            F.lit(None).cast("bigint").alias("first_row"),
            *[c for c in staged.columns[1:8]],
            F.array().cast("array<bigint>").alias("source_rows"),
            texts.alias("alias_skus"),
            texts.alias("resolution_notes"),
            parse.issues(
                (F.col("package.unit") == "unknown", "package_unit_unknown", F.concat(F.lit("cannot read a unit from "), quoted(package))),
                (F.col("price.amount_text").isNull(), "price_missing", F.concat(F.lit("no price in "), quoted(price))),
                parse.implausible_package(F.col("category"), F.col("package")),
            ).alias("issues"),
            F.when(told, card).alias("enrichment"),
            F.when(told, "enriched").otherwise("not_found_in_snapshot").alias("enrichment_status"),
        )

    # -- search ------------------------------------------------------------------------------

    def search(
        self, query: str, manufacturer: str | None = None, category: str | None = None, limit: int = 5
    ) -> DataFrame | None:
        """Products with score, match_type and explanation; None if the store is empty.

        A query that is a known number gives that product or, if a filter removes it, nothing:
        there is no fallback to similarity.
        """
        if limit < 1:
            raise ValueError(f"limit must be at least 1, got {limit}")
        now = self.snapshot()
        if not now.state["segments"]:
            return None
        manufacturer = " ".join((manufacturer or "").split()) or None
        category = " ".join((category or "").split()) or None
        folded, key = _fold(manufacturer) if manufacturer else None, category.upper() if category else None
        condition = ranking.passes(folded, key)
        number = self._one(sku_form(F.lit(query)))
        hit = now.find(number)
        if hit:
            return ranking.exact(now.product(hit), number).filter(condition).drop("row")
        vector = embedding.unit_vector(self.embedder.embed([query])[0])
        if now.state["dimensions"] not in (None, len(vector)):
            raise RuntimeError(f"store uses {now.state['dimensions']}-dimensional embeddings, got {len(vector)} dimensions")
        products, vectors, fields = (now.table(k, lambda s: can_pass(s, folded, key)) for k in ("products", "vectors", "fields"))
        hits = ranking.top_k(products.drop("row"), vectors, vector, limit, condition)
        drivers = ranking.strongest_fields(fields, hits, vector)
        return ranking.explain(hits, drivers, manufacturer, category)

    def search_many(
        self, queries: list[str], manufacturer: str | None = None, category: str | None = None, limit: int = 5
    ) -> DataFrame | None:
        """query, rank, canonical_sku, score and match_type of many searches in one scan, each as `search` gives it."""
        if limit < 1:
            raise ValueError(f"limit must be at least 1, got {limit}")
        now = self.snapshot()
        if not now.state["segments"]:
            return None
        folded = _fold(" ".join(manufacturer.split())) if manufacturer and manufacturer.strip() else None
        key = " ".join(category.split()).upper() if category and category.strip() else None
        wanted = lambda s: can_pass(s, folded, key)
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query bigint, text string")
        asked = asked.select("query", sku_form(F.col("text")).alias("sku"))
        named = now.table("identifiers").join(F.broadcast(asked), "sku").select("query", "canonical_sku")  # the caller's list
        exact = {r["query"]: r["canonical_sku"] for r in named.collect()}
        rest = [i for i in range(len(queries)) if i not in exact]
        vectors = [embedding.unit_vector(v) for v in self.embedder.embed([queries[i] for i in rest])] if rest else []
        passing = now.table("products", wanted).filter(ranking.passes(folded, key)).select("canonical_sku")
        table = now.table("vectors", wanted).join(passing, "canonical_sku", "left_semi")
        found = ranking.top_k_many(table, "canonical_sku", "vector", vectors, limit).withColumn("match_type", F.lit("semantic"))
        places = self.spark.createDataFrame(list(enumerate(rest)), "query bigint, place bigint")
        found = found.join(F.broadcast(places), "query").select(F.col("place").alias("query"), "rank", "canonical_sku", "score", "match_type")
        hits = self.spark.createDataFrame(sorted(exact.items()), "query bigint, canonical_sku string").join(passing, "canonical_sku", "left_semi")
        return found.unionAll(hits.select("query", F.lit(1).alias("rank"), "canonical_sku", F.lit(1.0).alias("score"), F.lit("exact_sku").alias("match_type")))
