"""An optional model over HTTP as the callable that ``operators.rerank`` takes."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from http.client import HTTPConnection, HTTPSConnection
from pathlib import Path
from urllib.parse import urlsplit

CONNECT_TIMEOUT, READ_TIMEOUT = 3.05, 12.0
TASK = 'Order all candidates by how well they fit what the customer said. Answer with a JSON object only: {"ranked": [doc_id, ...]}.'


def load_settings(path: str = ".env") -> dict[str, str]:
    """``NAME=value`` lines put into the environment, where what is set already wins; returns what was read."""
    found = {}
    if Path(path).is_file():
        for line in Path(path).read_text().splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and name and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    for name, value in found.items():
        os.environ.setdefault(name, value)
    return found


def http_caller(url: str, key: str | None, model: str, read_timeout: float = READ_TIMEOUT, connect_timeout: float = CONNECT_TIMEOUT) -> Callable[[str], dict] | None:
    """Posts a prompt; reads ids in order from the JSON object in the answer, and token counts from its usage. None without a key.

    Connecting has a time limit of its own, so that an unreachable host costs
    little.
    """
    if not key:
        return None
    place = urlsplit(url)
    kind = HTTPSConnection if place.scheme == "https" else HTTPConnection

    def call(prompt: str) -> dict:
        body = json.dumps({"model": model, "system": TASK, "prompt": prompt}).encode()
        conn = kind(place.hostname, place.port, timeout=connect_timeout)
        try:
            conn.connect()
            conn.sock.settimeout(read_timeout)
            conn.request("POST", place.path or "/", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            answer = conn.getresponse()
            text = answer.read().decode()
            if answer.status >= 400:
                raise OSError(f"status {answer.status}")
        finally:
            conn.close()
        return {"ranked": ranked_ids(text), **used(text)}

    return call


def used(text: str) -> dict[str, int]:
    """Token counts of an answer that is a JSON object with a usage of its own; zeros otherwise."""
    try:
        usage = json.loads(text).get("usage") or {}
    except (ValueError, AttributeError):
        usage = {}
    return {"prompt_tokens": int(usage.get("input_tokens", 0)), "completion_tokens": int(usage.get("output_tokens", 0))}


def ranked_ids(text: str) -> list[int]:
    """The ids of the first-brace-to-last-brace object's ``ranked`` list."""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in the answer")
    return [int(x) for x in json.loads(text[start : end + 1])["ranked"]]


def preflight(url: str, key: str | None, model: str) -> str:
    """``no_key``, ``ok`` or what went wrong."""
    call = http_caller(url, key, model)
    if call is None:
        return "no_key"
    try:
        call("{}")
    except Exception as e:  # the report is the point
        return f"failed: {e}"
    return "ok"
