"""Fetching manifests and tiles over HTTP, for ``sync.download``.

``opener`` is any function (url, headers) -> (status, headers, body), so tests
and other transports need no network.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Limits in bytes.
MOST_MANIFEST, MOST_TILE = 1 << 20, 16 << 20
Opener = Callable[[str, dict], tuple[int, dict, bytes]]


def open_url(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, dict(r.headers), r.read(MOST_TILE + 1)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), b""


@dataclass(frozen=True)
class TileFetcher:
    """Callable (z, x, y) -> bytes for one revision."""

    base: str
    template: str
    revision: str
    opener: Opener = open_url

    def url(self, z: int, x: int, y: int) -> str:
        places = {"{z}": str(z), "{x}": str(x), "{y}": str(y), "{revision}": urllib.parse.quote(self.revision, safe="")}
        out, rest = "", self.template
        while rest:
            hits = [(rest.find(p), p) for p in places if p in rest]
            if not hits:
                out += rest
                break
            at, place = min(hits)
            out, rest = out + rest[:at] + places[place], rest[at + len(place) :]
        return urllib.parse.urljoin(self.base, out)

    def __call__(self, z: int, x: int, y: int) -> bytes:
        url = self.url(z, x, y)
        status, headers, body = self.opener(url, {"Accept": "*/*"})
        if status != 200:
            raise OSError(f"{url}: status {status}")
        if len(body) > MOST_TILE:
            raise OSError(f"{url}: the tile is too large")
        wanted = {k.lower(): v for k, v in headers.items()}.get("x-checksum-sha256", "").strip().lower()
        if wanted:
            import hashlib

            if hashlib.sha256(body).hexdigest() != wanted:
                raise OSError(f"{url}: the checksum differs")
        return body


def fetch_manifest(url: str, known_revision: str = "", opener: Opener = open_url) -> dict | None:
    """The manifest; None if the known revision is still the current one."""
    status, _, body = opener(url, {"If-None-Match": f'"{known_revision}"'} if known_revision else {})
    if status == 304:
        return None
    if status != 200:
        raise OSError(f"{url}: status {status}")
    if len(body) > MOST_MANIFEST:
        raise OSError(f"{url}: the manifest is too large")
    out = json.loads(body)
    return None if known_revision and out.get("revision") == known_revision else out
