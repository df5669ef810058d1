"""A read-only JSON service over a library, for one host: each request is one query, its body streamed row by row."""

from __future__ import annotations

import json
import mimetypes
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.api import Library
from auralith.operators import catalog, serving

PAGE = b"<!DOCTYPE html><html><head><meta charset=utf-8><title>Library</title></head><body><h1>Library</h1><p><a href=/api/samples>samples</a> <a href=/api/tags>tags</a> <a href=/api/clusters>clusters</a></p></body></html>"


class Refused(Exception):
    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


def _number(text: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise Refused(400, "invalid id") from e


def answer(lib: Library, path: str, query: dict[str, str]) -> DataFrame | dict | str:
    """What a path answers: rows, one object, or (for a sample's audio) the path of a file."""
    parts = [unquote(p) for p in path.strip("/").split("/")]
    if parts == ["api", "health"]:
        return {"status": "ok"}
    if parts[:1] != ["api"] or len(parts) < 2:
        raise Refused(404, "not found")
    tables, rest = lib.tables(), parts[2:]
    if parts[1] == "samples" and not rest:
        return serving.samples(tables, query.get("q", ""), query.get("tag", ""))
    if parts[1] == "samples" and len(rest) in (1, 2):
        found = serving.sample(tables, _number(rest[0]))
        row = found.first()
        if row is None or len(rest) == 2 and rest[1] != "audio":
            raise Refused(404, "not found")
        return row["path"] if len(rest) == 2 else json.loads(found.toJSON().first())
    if parts[1] == "tags" and not rest:
        return serving.tags(tables)
    if parts[1] == "tags" and len(rest) == 2 and rest[1] == "samples":
        own = catalog.samples_by_tag(tables["samples"], tables["tags"], tables["sample_tags"], rest[0])
        return catalog.samples_with_tags(own, tables["tags"], tables["sample_tags"]).orderBy("path")
    if parts[1] == "clusters" and not rest:
        return serving.clusters(tables, query.get("method") or "kmeans", query.get("projection") or "tsne")
    if parts[1] == "clusters" and len(rest) == 1:
        try:
            return json.loads(serving.cluster(tables, _number(rest[0])).toJSON().first())
        except LookupError as e:
            raise Refused(404, str(e)) from e
    raise Refused(404, "not found")


def _body(found: DataFrame) -> Iterator[bytes]:
    """A JSON array; rows come partition by partition."""
    yield b"["
    whole = found.select(F.to_json(F.struct("*")).alias("json"))
    for k, row in enumerate(whole.toLocalIterator()):
        yield (b"," if k else b"") + row["json"].encode()
    yield b"]"


def serve(lib: Library, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _start(self, status: int, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Connection", "close")
            self.end_headers()

        def do_GET(self):  # noqa: N802
            url = urlsplit(self.path)
            if url.path in ("", "/"):
                self._start(200, "text/html; charset=utf-8")
                self.wfile.write(PAGE)
                return
            try:
                found = answer(lib, url.path, {k: v[0].strip() for k, v in parse_qs(url.query).items()})
            except Refused as e:
                self._start(e.status, "application/json")
                self.wfile.write(json.dumps({"error": str(e)}).encode())
                return
            except Exception as e:  # a failed query is the server's error
                self._start(500, "application/json")
                self.wfile.write(json.dumps({"error": str(e)[:500]}).encode())
                return
            if isinstance(found, str):
                self._start(200, mimetypes.guess_type(found)[0] or "application/octet-stream")
                with open(found, "rb") as f:
                    while part := f.read(1 << 16):
                        self.wfile.write(part)
                return
            self._start(200, "application/json")
            for part in [json.dumps(found).encode()] if isinstance(found, dict) else _body(found):
                self.wfile.write(part)

        def refuse(self):
            self._start(405, "application/json")
            self.wfile.write(b'{"error": "method not allowed"}')

        do_POST = do_PUT = do_DELETE = do_PATCH = refuse  # noqa: N815

    if port < 0:
        raise ValueError("port must not be negative")
    return ThreadingHTTPServer((host, port), Handler)
