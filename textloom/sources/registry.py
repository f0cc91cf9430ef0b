"""Schema registries: subjects with numbered versions, each schema with an id."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path
from typing import Protocol


class SchemaRegistry(Protocol):
    def subjects(self) -> list[str]: ...
    def has(self, subject: str) -> bool: ...
    def schema(self, subject: str, version: int | str = "latest") -> dict: ...
    def id_of(self, subject: str, version: int | str = "latest") -> int: ...
    def schemas_by_id(self, subject: str) -> dict[int, dict]: ...
    def register(self, subject: str, schema: dict) -> int: ...


class FileRegistry:
    """Subjects in one JSON file, or in memory where there is no path."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        self.data: dict[str, list[dict]] = json.loads(self.path.read_text()) if self.path and self.path.exists() else {}

    def subjects(self) -> list[str]:
        return sorted(self.data)

    def has(self, subject: str) -> bool:
        return subject in self.data

    def _version(self, subject: str, version: int | str) -> dict:
        if subject not in self.data:
            raise ValueError(f"{subject} isn't registered")
        return self.data[subject][-1 if version == "latest" else int(version) - 1]

    def schema(self, subject: str, version: int | str = "latest") -> dict:
        return self._version(subject, version)["schema"]

    def id_of(self, subject: str, version: int | str = "latest") -> int:
        return self._version(subject, version)["id"]

    def versions(self, subject: str) -> list[int]:
        return list(range(1, len(self.data.get(subject, [])) + 1))

    def schemas_by_id(self, subject: str) -> dict[int, dict]:
        if self.path and self.path.exists():  # another process may have registered more
            self.data = json.loads(self.path.read_text())
        return {v["id"]: v["schema"] for v in self.data.get(subject, [])}

    def register(self, subject: str, schema: dict) -> int:
        for v in self.data.get(subject, []):
            if v["schema"] == schema:
                return v["id"]
        ident = 1 + max((v["id"] for own in self.data.values() for v in own), default=0)
        self.data.setdefault(subject, []).append({"id": ident, "schema": schema})
        if self.path:
            self.path.write_text(json.dumps(self.data))
        return ident


class HttpRegistry:
    """Client of a registry service; several URLs, separated by commas, are tried in turn. Answers are remembered."""

    def __init__(self, urls: str, capacity: int = 2048, timeout: float = 5.0):
        self.urls = [u.strip().rstrip("/") for u in urls.split(",") if u.strip()]
        self.timeout = timeout
        self._get = lru_cache(capacity)(self._fetch)

    def __getstate__(self) -> dict:
        return {"urls": self.urls, "timeout": self.timeout}

    def __setstate__(self, state: dict) -> None:
        self.__init__(",".join(state["urls"]), timeout=state["timeout"])

    def _request(self, path: str, body: dict | None = None):
        import urllib.request

        error: Exception | None = None
        for url in self.urls:
            try:
                request = urllib.request.Request(url + path, data=json.dumps(body).encode() if body is not None else None, headers={"Content-Type": "application/vnd.schemaregistry.v1+json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except OSError as e:
                error = e
        raise ConnectionError(f"no registry answers: {error}")

    def _fetch(self, path: str):
        return self._request(path)

    def subjects(self) -> list[str]:
        return sorted(self._request("/subjects"))

    def has(self, subject: str) -> bool:
        return subject in self.subjects()

    def schema(self, subject: str, version: int | str = "latest") -> dict:
        ask = self._request if version == "latest" else self._get
        return json.loads(ask(f"/subjects/{subject}/versions/{version}")["schema"])

    def id_of(self, subject: str, version: int | str = "latest") -> int:
        return self._request(f"/subjects/{subject}/versions/{version}")["id"]

    def versions(self, subject: str) -> list[int]:
        return list(self._request(f"/subjects/{subject}/versions"))

    def schemas_by_id(self, subject: str) -> dict[int, dict]:
        found = {}
        for v in self.versions(subject):
            answer = self._get(f"/subjects/{subject}/versions/{v}")
            found[answer["id"]] = json.loads(answer["schema"])
        return found

    def register(self, subject: str, schema: dict) -> int:
        return self._request(f"/subjects/{subject}/versions", {"schema": json.dumps(schema)})["id"]
