"""The read interface: a user's features by HTTP path, over the online table."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from ..functions.scalars import valid_user_id
from .jobs import user_features

USERS = "/v1/features/users/"


class FeatureApi:
    """Answers paths; table: gives the online vectors as they are now."""

    def __init__(self, table: Callable[[], DataFrame]):
        self.table = table

    def respond(self, path: str) -> tuple[int, dict, dict[str, str]]:
        """(status, body, headers): 200, 404 for an unknown path, 422 for what is no user id, 503 with
        Retry-After while the table can't be read."""
        if path == "/healthz":
            return 200, {"status": "ok"}, {}
        if path == "/readyz":
            return self._guarded(lambda: (self.table().limit(1).count(), {"status": "ready"})[1])
        if not path.startswith(USERS):
            return 404, {"detail": "not found"}, {}
        user = path[len(USERS) :]
        if not valid_user_id(user):
            return 422, {"detail": "a user id has 1 to 128 letters, digits or any of _ - . :"}, {}
        return self._guarded(lambda: user_features(self.table(), user))

    def _guarded(self, answer: Callable[[], dict]) -> tuple[int, dict, dict[str, str]]:
        try:
            return 200, answer(), {}
        except Exception as problem:  # noqa: BLE001 - whatever keeps the table from being read
            return 503, {"detail": f"the feature table can't be read: {type(problem).__name__}"}, {"Retry-After": "1"}


def server(api: FeatureApi, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't running yet: call serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802 - the name that the base class calls
            status, body, headers = api.respond(self.path.partition("?")[0])
            raw = json.dumps(body).encode()
            self.send_response(status)
            for k, v in ({"Content-Type": "application/json", "Content-Length": str(len(raw))} | headers).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
