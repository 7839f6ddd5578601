"""The HTTP surface as a WSGI application on the standard library: a page, search, add, delete."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable
from dataclasses import MISSING, fields
from pathlib import Path
from urllib.parse import parse_qs, unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfmark import workspace
from shelfmark.functions import parse
from shelfmark.operators import words
from shelfmark.plans.catalogue import Catalogue, build_catalogue
from shelfmark.store import CatalogueStore, ConcurrentWrite, InvalidProduct, ProductConflict, ProductInput, ProductNotFound

PAGE = Path(__file__).parent / "page.html"
PRODUCTS = "/api/products"
STATUS = {
    200: "200 OK",
    201: "201 Created",
    404: "404 Not Found",
    405: "405 Method Not Allowed",
    409: "409 Conflict",
    422: "422 Unprocessable Entity",
    503: "503 Service Unavailable",
}


def shown(products: DataFrame) -> DataFrame:
    """The columns that clients see, and what a search adds to them."""
    extra = [c for c in ("score", "match_type", "explanation") if c in products.columns]
    return products.select(
        F.col("canonical_sku").alias("sku"),
        F.col("alias_skus").alias("aliases"),
        "name",
        "manufacturer",
        "category",
        parse.package_text(F.col("package")).alias("package"),
        parse.price_text(F.col("price")).alias("price"),
        *extra,
    )


def _input(body: bytes) -> ProductInput:
    try:
        data = json.loads(body or b"{}")
    except ValueError as error:
        raise InvalidProduct("the body is not JSON") from error
    if not isinstance(data, dict):
        raise InvalidProduct("the body is not an object")
    given = {}
    for f in fields(ProductInput):
        value = data.get(f.name, None if f.default is MISSING else f.default)
        if value is None and f.name == "category":
            given[f.name] = None
        elif not isinstance(value, str) or (f.default is MISSING and not value):
            raise InvalidProduct(f"{f.name} must be a text" + " that is not empty" * (f.default is MISSING))
        else:
            given[f.name] = value
    return ProductInput(**given)


class Api:
    """`build` gives the catalogue that a store never seeded before starts with (see `CatalogueStore.seed`)."""

    def __init__(self, open_store: Callable[[], CatalogueStore], build: Callable[[Callable], Catalogue] | None = None):
        self._open, self._build, self._store, self._lock = open_store, build, None, threading.Lock()

    @property
    def store(self) -> CatalogueStore:
        """Opened, and seeded if need be, by the first request that needs it; others wait for that."""
        if self._store is None:
            with self._lock:
                if self._store is None:
                    store = self._open()
                    if self._build is not None and not store.seeded:
                        store.seed(self._build)
                    self._store = store
        return self._store

    def search(self, q: str = "", manufacturer: str = "", category: str = "", limit: int = 10) -> dict:
        if not q.strip():
            return {"results": []}
        found = self.store.search(q, manufacturer or None, category or None, max(1, limit))
        return {"results": [] if found is None else [r.asDict(recursive=True) for r in shown(found).collect()]}

    def add(self, data: ProductInput) -> dict:
        row: Row = self.store.add(data)
        one = self.store.spark.createDataFrame([row], self.store.products().drop("product_id").select(*row.__fields__).schema)
        issues = [f"{i['code']}: {i['detail']}" for i in row["issues"]]
        return {"product": shown(one).collect()[0].asDict(recursive=True), "issues": issues}

    def delete(self, sku: str) -> dict:
        gone = self.store.delete(sku)
        return {"deleted_sku": gone.canonical_sku, "deleted_aliases": gone.alias_skus}

    def respond(self, method: str, path: str, query: str = "", body: bytes = b"") -> tuple[int, dict]:
        try:
            if path == "/api/search" and method == "GET":
                given = {k: v[-1] for k, v in parse_qs(query).items() if k in ("q", "manufacturer", "category", "limit")}
                if "limit" in given:
                    given["limit"] = int(given["limit"])
                return 200, self.search(**given)
            if path == PRODUCTS and method == "POST":
                return 201, self.add(_input(body))
            if path.startswith(f"{PRODUCTS}/") and method == "DELETE":
                return 200, self.delete(unquote(path[len(PRODUCTS) + 1 :]))
        except (InvalidProduct, ProductConflict, ProductNotFound) as error:
            code = {InvalidProduct: 422, ProductConflict: 409, ProductNotFound: 404}[type(error)]
            return code, {"detail": str(error)}
        except ConcurrentWrite as error:  # after waiting for others; nothing was changed
            return 503, {"detail": str(error)}
        except ValueError as error:
            return 422, {"detail": str(error)}
        known = path in ("/", "/api/search", PRODUCTS) or path.startswith(f"{PRODUCTS}/")
        return (405, {"detail": "method not allowed"}) if known else (404, {"detail": "not found"})

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        if environ["REQUEST_METHOD"] == "GET" and environ.get("PATH_INFO", "") in ("", "/"):
            start_response(STATUS[200], [("Content-Type", "text/html; charset=utf-8")])
            return [PAGE.read_bytes()]
        length = int(environ.get("CONTENT_LENGTH") or 0)
        body = environ["wsgi.input"].read(length) if length else b""
        code, payload = self.respond(environ["REQUEST_METHOD"], environ.get("PATH_INFO", ""), environ.get("QUERY_STRING", ""), body)
        start_response(STATUS[code], [("Content-Type", "application/json; charset=utf-8")])
        return [json.dumps(payload, ensure_ascii=False).encode()]


def serve(api: Api, host: str = "127.0.0.1", port: int = 8000) -> None:
    """One thread for each request: a search that waits for Spark does not hold up others."""
    from socketserver import ThreadingMixIn
    from wsgiref.simple_server import WSGIServer, make_server

    class Server(ThreadingMixIn, WSGIServer):
        daemon_threads = True

    with make_server(host, port, api, server_class=Server) as server:
        server.serve_forever()


def from_files(spark: SparkSession, path: str, csv: str, html: str | None = None) -> Api:
    """A store whose embedder has learnt its words from the catalogue that the store starts with.

    The model is kept in the store's folder `model`; the first request builds the catalogue, step by
    step and once, learns from its products and seeds the store with them.
    """
    built: list[Catalogue] = []

    def step(table: DataFrame, kind: str) -> DataFrame:
        folder = workspace.new_folder(spark, kind)
        table.write.parquet(folder)
        return spark.read.parquet(folder)

    def opened() -> CatalogueStore:
        if not CatalogueStore.has_model(spark, path):
            built.append(build_catalogue(spark, csv, html, step))
            words.save(words.train(built[0].products), spark, f"{path}/model")
        return CatalogueStore(spark, path, words.load(spark, f"{path}/model"))

    return Api(opened, lambda save: built.pop() if built else build_catalogue(spark, csv, html, save))


def main(argv: list[str] | None = None) -> None:
    """Serve a store that is seeded from the given files on the first request, unless it was before."""
    from argparse import ArgumentParser

    from pyspark.sql import SparkSession

    parser = ArgumentParser(description=main.__doc__)
    parser.add_argument("store", help="folder of the store")
    parser.add_argument("csv", help="product rows")
    parser.add_argument("html", nargs="?", help="page or folder of pages with manufacturer cards")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8000)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("shelfmark").getOrCreate()
    serve(from_files(spark, given.store, given.csv, given.html), given.host, given.port)


if __name__ == "__main__":
    main()
