"""HTTP service: GET /health and POST /ask, on the standard library's server.

A bad request is 422 and reaches nothing behind the service; a failure behind it is 502; a refusal is an answer, 200."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .operators import answer, search

FIELDS = {"question": str, "top_k": int, "threshold": (int, float), "model": str, "doc_kind": (str, type(None))}
DEFAULTS = {"top_k": search.TOP_K, "threshold": search.REFUSAL, "model": "offline", "doc_kind": None}


def parse_request(body: bytes) -> dict[str, Any]:
    """The fields of a question; ValueError for what is missing, of a wrong type or out of range. Unknown fields are ignored."""
    try:
        sent = json.loads(body or b"null")
    except ValueError:
        raise ValueError("the body is not JSON") from None
    if not isinstance(sent, dict) or "question" not in sent:
        raise ValueError("question is required")
    asked = DEFAULTS | {k: v for k, v in sent.items() if k in FIELDS}
    for k, kind in FIELDS.items():
        if not isinstance(asked[k], kind) or isinstance(asked[k], bool):
            raise ValueError(f"{k} has the wrong type")
    answer.validate_request(asked["question"], asked["top_k"], asked["threshold"], asked["doc_kind"])
    return asked


def respond(method: str, path: str, body: bytes, asker) -> tuple[int, dict[str, Any]]:
    """Status and JSON. asker: .name, and .ask(question, top_k, threshold, model, doc_kind)."""
    path = path.split("?")[0].rstrip("/") or "/"
    if path == "/health":
        return (200, {"status": "ok", "index": asker.name}) if method == "GET" else (405, {"detail": "GET only"})
    if path != "/ask":
        return 404, {"detail": "no such path"}
    if method != "POST":
        return 405, {"detail": "POST only"}
    try:
        asked = parse_request(body)
    except ValueError as e:
        return 422, {"detail": str(e)}
    try:
        return 200, asker.ask(**asked)
    except Exception as e:  # noqa: BLE001  whatever failed is behind the service
        return 502, {"detail": f"upstream failure: {e}"}


def server(asker, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = respond(self.command, self.path, body, asker)
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
