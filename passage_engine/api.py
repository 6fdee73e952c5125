"""GET /ask?doc_id=...&question=...[&top_k=6][&use_llm=false] over HTTP, on the standard library's server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from passage_engine.plans.engine import Engine
from passage_engine.providers import LanguageModel


def server(engine: Engine, host: str = "127.0.0.1", port: int = 8000, model: LanguageModel | None = None) -> ThreadingHTTPServer:
    """A server to be started with ``serve_forever``; each request is a job of its own in the engine's session."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if url.path != "/ask":
                return self._send(404, {"error": "not found"})
            if not {"doc_id", "question"} <= asked.keys():
                return self._send(422, {"error": "doc_id and question are needed"})
            try:
                k = int(asked.get("top_k", engine.defaults.top_k))
                own = model if asked.get("use_llm", "false").lower() in ("1", "true", "yes") else None
                self._send(200, engine.ask_json(asked["question"], asked["doc_id"], k=k, model=own))
            except FileNotFoundError as e:
                self._send(404, {"error": str(e)})
            except ValueError as e:
                self._send(422, {"error": str(e)})

        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
