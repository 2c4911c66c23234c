"""A memory service behind JSON over HTTP, as a governed store's client."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any
from urllib.parse import quote


class HTTPFault(RuntimeError):
    """An answer of 400 or more; `status` and `retry_after` are what the service said."""

    def __init__(self, status: int, body: str, retry_after: str | None = None):
        super().__init__(f"HTTP {status}: {body[:200]}")
        self.status = status
        self.retry_after = float(retry_after) if retry_after and retry_after.isdigit() else None


class HTTPClient:
    """POSTs JSON to paths under a base address; a path may hold {subject_id}."""

    def __init__(
        self,
        base: str,
        *,
        add: str = "/add",
        search: str = "/search",
        delete: str = "/delete",
        read: str | None = "/get_all",
        headers: dict[str, str] | None = None,
        timeout: float = 30.0,
    ):
        self.base, self.paths, self.headers, self.timeout = base.rstrip("/"), {"add": add, "search": search, "delete": delete, "read": read}, headers or {}, timeout

    def _post(self, what: str, body: dict) -> Any:
        """The parsed answer; None for an empty one, the text itself if it is no JSON."""
        path = self.paths[what].replace("{subject_id}", quote(str(body.get("subject_id", "")), safe=""))
        request = urllib.request.Request(self.base + path, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                text = answer.read().decode()
        except urllib.error.HTTPError as e:
            raise HTTPFault(e.code, e.read().decode(errors="replace"), e.headers.get("Retry-After")) from e
        if not text:
            return None
        try:
            return json.loads(text)
        except ValueError:
            return text

    def add(self, text: str, subject_id: str) -> Any:
        return self._post("add", {"text": text, "subject_id": subject_id})

    def search(self, query: str, subject_id: str | None = None) -> Any:
        return self._post("search", {"query": query, "subject_id": subject_id})

    def delete(self, subject_id: str) -> Any:
        return self._post("delete", {"subject_id": subject_id})

    def read(self, subject_id: str) -> Any:
        return self._post("read", {"subject_id": subject_id})
