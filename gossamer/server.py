"""A result page over HTTP: GET /?q=words gives the hits of an index as HTML, /text?q=words as text."""

from __future__ import annotations

import html
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .operators import snippets
from .plans import runs
from .shared import scratch

FORM = '<form action="/"><input name="q" value="{}"><input type="submit" value="Search"></form>'


def page(spark: SparkSession, target: str, query: str, k: int = 10, as_text: bool = False) -> str:
    """The best k hits of `target` for a query; without a query the form alone."""
    found = ""
    if query.strip():
        with scratch():
            rows = runs.hits(spark, target, query, k)
            found = (snippets.as_text(rows) if as_text else snippets.as_html(rows)).first()[0]
    if as_text:
        return found
    return f"<html><head><title>{html.escape(query)}</title></head><body>{FORM.format(html.escape(query, quote=True))}{found}</body></html>"


def server(spark: SparkSession, target: str, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that answers until it is shut down; port 0 takes any free one. Errors are answered with 500 and their text."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path not in ("/", "/text"):
                return self.send_error(404)
            try:
                body, status = page(spark, target, parse_qs(url.query).get("q", [""])[0], as_text=url.path == "/text"), 200
            except Exception as e:  # the request fails, not the server
                body, status = str(e).splitlines()[0], 500
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"text/{'plain' if url.path == '/text' or status != 200 else 'html'}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
