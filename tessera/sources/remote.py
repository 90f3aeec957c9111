"""Metadata that is fetched from elsewhere, with a time limit, and the templates that are made of it."""

from __future__ import annotations

import json
import urllib.request


class FetchError(Exception):
    """A reply that did not come in time, or is not what it should be."""


def fetch_json(url: str, timeout: float = 10.0) -> object:
    """The JSON of a URL. One small reply, read by the driver."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            return json.loads(reply.read())
    except (OSError, ValueError) as e:
        raise FetchError(f"{url}: {e}") from e


def tile_template(url: str, timeout: float = 10.0) -> tuple[str, list[str]]:
    """(URL template without its scheme, names of subdomains) of an imagery service, from its metadata."""
    reply = fetch_json(url, timeout)
    try:
        found = reply["resourceSets"][0]["resources"][0]
        image, names = found["imageUrl"], found["imageUrlSubdomains"]
    except (KeyError, IndexError, TypeError) as e:
        raise FetchError(f"{url}: no imageUrl and subdomains in the reply") from e
    if not isinstance(image, str) or not isinstance(names, list) or not names:
        raise FetchError(f"{url}: imageUrl or subdomains of another type")
    return image.partition(":")[2] if image.lower().startswith(("http:", "https:")) else image, [str(n) for n in names]
