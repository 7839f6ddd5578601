"""Many writers and readers of one store; what a search opens; what vacuum removes."""

import subprocess
import sys
import threading
import time

import pytest

from shelfmark import store as module
from shelfmark.api import Api
from shelfmark.operators.enrich import without_cards
from shelfmark.operators.normalize import normalize
from shelfmark.operators.resolve import resolve
from shelfmark.plans.catalogue import CANDIDATES, Catalogue
from shelfmark.store import CatalogueStore, ConcurrentWrite, ProductConflict, ProductInput, ProductNotFound

from test_api import call
from test_catalogue import rows
from test_store import Keywords


def seeded(spark, path, n=40):
    made = [{"sku": f"XX-{i}", "name": f"thing {i}", "manufacturer": ["Acme", "Łódź"][i % 2], "category": "chemicals"} for i in range(n)]
    records = normalize(rows(spark, *made, {"sku": "XX-7A", "name": "thing 7", "manufacturer": "Łódź", "category": "chemicals"}))
    store = CatalogueStore(spark, str(path), Keywords())
    store.seed(Catalogue(without_cards(resolve(records)), spark.createDataFrame([], CANDIDATES), records))
    return store


def together(*jobs):
    """Run them in threads that start at once; their results in order, exceptions too."""
    out, gate = [None] * len(jobs), threading.Barrier(len(jobs))

    def run(i, job):
        gate.wait()
        try:
            out[i] = job()
        except Exception as error:
            out[i] = error

    threads = [threading.Thread(target=run, args=x) for x in enumerate(jobs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_writers_wait_for_each_other(spark, tmp_path, monkeypatch):
    """Threads that add through the API, while segments are compacted under them, all succeed; one number goes to one."""
    monkeypatch.setattr(module, "COMPACT_SEGMENTS", 5)
    api = Api(lambda: CatalogueStore(spark, str(tmp_path / "s"), Keywords()))
    product = lambda sku: {"sku": sku, "name": "cold", "manufacturer": "m"}

    def adds(i):
        return lambda: [call(api, "POST", "/api/products", data=product(f"T-{i}-{j}"))[0] for j in range(2)]

    same = [lambda: call(api, "POST", "/api/products", data=product("SAME-1"))[0]] * 2
    codes = together(*[adds(i) for i in range(6)], *same)
    assert codes[:6] == [[201, 201]] * 6 and sorted(codes[6:]) == [201, 409]
    numbers = {r["sku"] for r in api.store.identifiers().collect()}
    assert numbers == {f"T-{i}-{j}" for i in range(6) for j in range(2)} | {"SAME-1"}
    assert api.store.count_products() == 13 == api.store.products().count() == api.store.product_vectors().count()
    deletes = [lambda: call(api, "DELETE", "/api/products/SAME-1")[0]] * 2 + [lambda: call(api, "DELETE", "/api/products/T-0-0")[0]]
    codes = together(*deletes)
    assert sorted(codes[:2]) == [200, 404] and codes[2] == 200 and api.store.count_products() == 11
    assert api.store.events().count() == 15


def test_a_change_is_tested_again_on_what_is_new(spark, tmp_path, monkeypatch):
    """Another writer publishes between the test and the commit."""
    store, other = seeded(spark, tmp_path / "s"), CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    write = CatalogueStore._segment

    def meanwhile(change):
        def run(self, *given, **more):
            monkeypatch.setattr(CatalogueStore, "_segment", write)
            change()
            return write(self, *given, **more)

        monkeypatch.setattr(CatalogueStore, "_segment", run)

    meanwhile(lambda: other.add(ProductInput("A-1", "other", "m")))
    store.add(ProductInput("A-2", "mine", "m"))
    meanwhile(lambda: other.add(ProductInput("A-3", "other", "m")))
    with pytest.raises(ProductConflict):
        store.add(ProductInput("A-3", "mine", "m"))
    meanwhile(lambda: other.delete("A-3"))
    store.add(ProductInput("A-4", "mine", "m"))
    monkeypatch.setattr(module, "COMPACT_DEAD", 0)
    event = CatalogueStore._event
    # The row that is about to die moves to a compacted segment; then it dies first elsewhere.
    monkeypatch.setattr(CatalogueStore, "_event", lambda self, *x: (monkeypatch.setattr(CatalogueStore, "_event", event), other.delete("XX-5"), event(self, *x))[-1])
    assert store.delete("XX-4").canonical_sku == "XX-4"
    monkeypatch.setattr(CatalogueStore, "_event", lambda self, *x: (monkeypatch.setattr(CatalogueStore, "_event", event), other.delete("XX-6"), event(self, *x))[-1])
    with pytest.raises(ProductNotFound):
        store.delete("XX-6")
    left = {r["canonical_sku"] for r in other.products().collect()}
    assert {"A-1", "A-2", "A-4"} <= left and not {"A-3", "XX-4", "XX-5", "XX-6"} & left and len(left) == 40


def test_waiting_has_an_end(spark, tmp_path, monkeypatch):
    store = seeded(spark, tmp_path / "s", 2)
    monkeypatch.setattr(module, "BUSY_SECONDS", 0.3)

    def refuse(self, version, state):
        raise ConcurrentWrite("taken")

    monkeypatch.setattr(CatalogueStore, "_publish", refuse)
    began = time.time()
    with pytest.raises(ConcurrentWrite):
        store.delete("XX-1")
    assert 0.3 <= time.time() - began < 20
    api = Api(lambda: store)
    assert call(api, "POST", "/api/products", data={"sku": "n", "name": "n", "manufacturer": "n"})[0] == 503
    assert store.count_products() == 3


@pytest.mark.parametrize("way", ["_link", "_claim"])
def test_a_version_has_one_writer(spark, tmp_path, monkeypatch, way):
    """Both ways of publishing let one of many through; a dead writer's marker does not stay for ever.

    Markers are tried in turn: local files, unlike stores that need them, don't create one exclusively.
    """
    store = CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    monkeypatch.setattr(CatalogueStore, "_link", getattr(CatalogueStore, way))
    state = store._state()[1]
    for version in range(1, 6):
        jobs = [lambda i=i, v=version: store._publish(v, state | {"by": i}) for i in range(8)]
        got = together(*jobs) if way == "_link" else [together(job)[0] for job in jobs]
        assert sum(x is None for x in got) == 1 and all(x is None or isinstance(x, ConcurrentWrite) for x in got)
        assert got[store._state(version)[1]["by"]] is None
    if way == "_claim":
        store._put("manifests/0000000006.claim", "")
        with pytest.raises(ConcurrentWrite):
            store._publish(6, state)
        monkeypatch.setattr(module, "CLAIM_SECONDS", -1.0)
        with pytest.raises(ConcurrentWrite):
            store._publish(6, state)
        store._publish(6, state)


def test_seeding_twice_at_once(spark, tmp_path):
    """Of two that seed, one does; both return."""
    records = normalize(rows(spark, {"sku": "XX-1", "name": "a", "manufacturer": "m"}))
    catalogue = Catalogue(without_cards(resolve(records)), spark.createDataFrame([], CANDIDATES), records)
    stores = [CatalogueStore(spark, str(tmp_path / "s"), Keywords()) for _ in range(2)]
    assert together(*[lambda s=s: s.seed(catalogue) for s in stores]) == [None, None]
    assert stores[0].count_products() == 1 and stores[0].events().count() == 1


def test_seeding_from_steps_computes_each_once(spark, tmp_path):
    """Every step is saved before the next reads it; only the lineage stays of what was saved."""
    seen = []

    def build(save):
        records = save(normalize(rows(spark, {"sku": "XX-1", "name": "a", "manufacturer": "m"})), "records")
        seen.append(records.inputFiles())
        merged = save(resolve(records), "merged")
        assert merged.inputFiles() and "Scan ExistingRDD" not in merged._jdf.queryExecution().executedPlan().toString()
        return Catalogue(without_cards(merged), spark.createDataFrame([], CANDIDATES), records)

    store = CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    store.seed(build)
    store.seed(build)
    assert len(seen) == 1 and store.records().inputFiles() == seen[0] and store.count_products() == 1
    assert not list((tmp_path / "s" / "merged").glob("*")) and not list((tmp_path / "s" / "drafts").glob("*"))


def read_files(df):
    return sorted({f.partition("/s/")[2].split("/part-")[0] for f in df.inputFiles()})


def test_an_exact_search_opens_only_files_that_match(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BUCKET_ROWS", 4)
    monkeypatch.setattr(module, "NUMBERS", 3)
    store = seeded(spark, tmp_path / "s")
    for i in range(3):
        store.add(ProductInput(f"A-{i}", "n", "m"))
    state = store._state()[1]
    assert state["segments"][0]["buckets"] == 10 and state["segments"][0]["numbers"] is None
    opened = []
    schema = spark.read.schema("sku string").__class__
    parquet = schema.parquet
    monkeypatch.setattr(schema, "parquet", lambda self, *paths, **kw: (opened.extend(p.partition("/s/")[2] for p in paths), parquet(self, *paths, **kw))[1])
    for number, segment in (("xx-13", 0), ("xx-7a", 0), ("a-1", 2)):
        opened.clear()
        hit = store.search(number)
        want = state["segments"][segment]
        assert hit.collect()[0]["match_type"] == "exact_sku" and len(read_files(hit)) == 1
        assert read_files(hit)[0].startswith(f"{want['products']}/bucket=")
        # One folder of numbers, and one of products.
        assert len(opened) == 2 and opened[0].startswith(f"{want['identifiers']}/bucket=")
    opened.clear()
    assert store.snapshot().find("NONE-1") is None and len(opened) == 1
    assert store.products().count() == 43 and store.identifiers().count() == 44


def test_deleting_needs_no_exchange(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BUCKET_ROWS", 9)
    store = seeded(spark, tmp_path / "s")
    for i in (3, 4, 7, 30):
        store.delete(f"XX-{i}")
    for table, n in ((store.products(), 36), (store.product_vectors(), 36), (store.identifiers(), 36), (store.field_vectors(), 108)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert table.count() == n
    assert store.search("XX-7A").collect()[0]["match_type"] == "semantic"


def test_segments_that_cannot_pass_are_not_read(spark, tmp_path, monkeypatch):
    store = seeded(spark, tmp_path / "s", 6)
    store.add(ProductInput("A-1", "cold a", "Ärzte GmbH", "PCR_REAGENT"))
    store.add(ProductInput("A-2", "cold b", "Other", None))
    first, second, third = store._state()[1]["segments"]
    cases = {("arz", None): 1, (None, "pcr_reagent"): 1, ("lodz", "lab_chemical"): 1, ("m", "pcr_reagent"): 1, ("zz", None): 0, ("o", None): 2, (None, None): 3}
    for (maker, category), n in cases.items():
        key = category.upper() if category else None
        assert sum(module.can_pass(s, maker, key) for s in (first, second, third)) == n
        found = {r["canonical_sku"] for r in store.search("cold", maker, category, limit=20).collect()}
        every = store.products().collect()
        assert found == {
            r["canonical_sku"] for r in every if (not maker or maker in r["manufacturer_folded"]) and (not key or r["category"] == key)
        }
    # Manufacturers too many to list are told by their trigrams, which never lose one.
    segment = first | {"manufacturers": None, "trigrams": ["acm", "cme", "lod", "odz"]}
    assert [module.can_pass(segment, m, None) for m in ("acme", "cm", "lodz", "acmx", "odza")] == [True, True, True, False, False]


def test_manufacturers_beyond_the_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MANUFACTURERS", 1)
    segment = seeded(spark, tmp_path / "s", 4)._state()[1]["segments"][0]
    assert segment["manufacturers"] is None and segment["trigrams"] == ["acm", "cme", "lod", "odz"]


def test_vacuum_keeps_what_is_in_use(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "COMPACT_SEGMENTS", 2)
    monkeypatch.setattr(module, "COMPACT_EVENTS", 4)
    store = seeded(spark, tmp_path / "s", 4)
    with store.reading() as reader, store.reading(seconds=-1.0) as late:
        for i in range(5):
            store.add(ProductInput(f"A-{i}", "n", "m"))
        assert store.vacuum(keep_versions=1) == []  # all files are young
        gone = store.vacuum(keep_versions=1, older_than=-60.0)
        assert gone and reader.products().count() == 5 and reader.find("XX-1")["canonical_sku"] == "XX-1"
        assert late.version == reader.version
        assert f"manifests/{reader.version:010d}.json" not in gone
    store.vacuum(keep_versions=1, older_than=-60.0)
    version, state = store._state()
    named = {s[k] for s in state["segments"] for k in module.KINDS} | {*state["events"], state["records"], state["candidates"]}
    files = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "s").glob("*/*") if not p.name.startswith(".")}
    assert files == named | {f"manifests/{version:010d}.json"}
    assert store.count_products() == 10 == store.products().count() and store.events().count() == 6
    assert store.search("A-3").count() == 1


WRITER = """
import sys
sys.path[:0] = {path!r}
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from test_store import Keywords
from shelfmark.store import CatalogueStore, ProductInput
store = CatalogueStore(spark, {store!r}, Keywords())
for i in range(3):
    store.add(ProductInput(f"{name}-{{i}}", "n", "m"))
"""


def test_writers_in_several_processes(spark, tmp_path):
    path = [p for p in sys.path if p]
    started = [
        subprocess.Popen([sys.executable, "-c", WRITER.format(path=path, store=str(tmp_path / "s"), name=name)], stderr=subprocess.DEVNULL)
        for name in ("P", "Q")
    ]
    assert [p.wait(timeout=300) for p in started] == [0, 0]
    store = CatalogueStore(spark, str(tmp_path / "s"), Keywords())
    assert {r["canonical_sku"] for r in store.products().collect()} == {f"{p}-{i}" for p in "PQ" for i in range(3)}
