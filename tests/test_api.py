import io
import json
import threading

from pyspark.sql import functions as F

from shelfmark.api import Api
from shelfmark.store import CatalogueStore
from shelfmark.streaming.state import compact, current, newest, publish

from test_store import Keywords, catalogue  # noqa: F401


def call(api, method, path, query="", data=None):
    body = json.dumps(data).encode() if data is not None else b""
    seen = []
    environ = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}
    out = b"".join(api(environ, lambda status, headers: seen.append(status)))
    return int(seen[0].split()[0]), json.loads(out)


def test_round_trip(spark, tmp_path):
    api = Api(lambda: CatalogueStore(spark, str(tmp_path / "s"), Keywords()))
    product = {"sku": "ac-1", "name": "Cold thing", "manufacturer": "Acme", "category": "LAB_CHEMICAL", "price": "10 PLN", "description": "cold"}
    assert call(api, "GET", "/api/search", "q=cold") == (200, {"results": []})
    code, made = call(api, "POST", "/api/products", data=product)
    assert code == 201 and made["product"]["sku"] == "AC-1" and made["product"]["price"] == "10 PLN"
    assert made["issues"] == ["package_unit_unknown: cannot read a unit from ''"]
    assert call(api, "GET", "/api/search", "q=AC-1")[1]["results"][0]["match_type"] == "exact_sku"
    assert call(api, "GET", "/api/search", "q=cold&limit=0")[1]["results"][0]["sku"] == "AC-1"
    assert call(api, "GET", "/api/search", "q=+")[1] == {"results": []}
    assert call(api, "POST", "/api/products", data=product)[0] == 409
    assert call(api, "POST", "/api/products", data=product | {"category": "OTHER", "sku": "b"})[0] == 422
    assert call(api, "POST", "/api/products", data={"sku": "x"})[0] == 422
    assert call(api, "DELETE", "/api/products/ac-1") == (200, {"deleted_sku": "AC-1", "deleted_aliases": []})
    assert call(api, "DELETE", "/api/products/AC-1")[0] == 404
    assert call(api, "GET", "/nothing")[0] == 404 and call(api, "PUT", "/api/products")[0] == 405


def test_streamed_state_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.range(200).select(
        (F.col("id") % 17).alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, "delete").otherwise("add").alias("action")
    )
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    publish(newest(stream, "k", ["at"], ["action"]), out, str(tmp_path / "cp"), F.col("action") == "delete").awaitTermination(120)
    batch = sorted(map(tuple, newest(events, "k", ["at"], ["action"]).filter("action <> 'delete'").collect()))
    assert sorted(map(tuple, current(spark, out, "k").select("k", "at", "action").collect())) == batch
    compact(spark, out, "k", str(tmp_path / "small"))
    assert sorted(map(tuple, current(spark, str(tmp_path / "small"), "k").select("k", "at", "action").collect())) == batch


def test_page_and_seeding_on_first_request(spark, tmp_path, catalogue):
    opened = []

    def build(save):
        opened.append(1)
        return catalogue

    api = Api(lambda: CatalogueStore(spark, str(tmp_path / "s"), Keywords()), build)
    seen = []
    environ = {"REQUEST_METHOD": "GET", "PATH_INFO": "/", "wsgi.input": io.BytesIO()}
    page = b"".join(api(environ, lambda status, headers: seen.append((status, dict(headers)["Content-Type"]))))
    assert seen == [("200 OK", "text/html; charset=utf-8")] and b"/api/search" in page and not opened
    threads = [threading.Thread(target=lambda: api.store) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert opened == [1] and api.store.count_products() == 2
    again = Api(lambda: CatalogueStore(spark, str(tmp_path / "s"), Keywords()), build)
    assert again.store.seeded and opened == [1]
    assert call(api, "PUT", "/")[0] == 405


def test_main_serves_a_store_seeded_from_files(spark, tmp_path, monkeypatch):
    import shelfmark.api as module

    (tmp_path / "p.csv").write_text(
        "nazwa,nr_katalogowy,producent,kategoria,opakowanie,cena,atrybuty_dodatkowe\nThing,XX-10002,Maker,pomiary,5 szt,1 zl,\n", encoding="utf-8"
    )
    served = []
    monkeypatch.setattr(module, "serve", lambda api, host, port: served.append((api, host, port)))
    module.main([str(tmp_path / "store"), str(tmp_path / "p.csv"), "--port", "8123"])
    (api, host, port), = served
    assert (host, port) == ("127.0.0.1", 8123)
    assert [r["sku"] for r in api.respond("GET", "/api/search", "q=xx-10002")[1]["results"]] == ["XX-10002"]
