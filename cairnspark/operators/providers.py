"""Embedders behind HTTP services, as callables from texts to vectors."""

from __future__ import annotations

from collections.abc import Callable

#: Texts sent in one request.
BATCH = 96
Post = Callable[[str, dict, dict], dict]


def post_json(url: str, body: dict, headers: dict) -> dict:
    import json
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as r:
        return json.load(r)


def _in_batches(texts: list[str], ask: Callable[[list[str]], list[list[float]]]) -> list[list[float]]:
    out: list[list[float]] = []
    for i in range(0, len(texts), BATCH):
        part = ask(texts[i : i + BATCH])
        if len(part) != len(texts[i : i + BATCH]):
            raise ValueError("the service returned another number of vectors")
        out += part
    return out


def data_list_embedder(url: str, model: str, key: str | None = None, post: Post = post_json) -> Callable[[list[str]], list[list[float]]]:
    """Services that answer ``{"data": [{"index", "embedding"}]}`` to ``{"model", "input"}`` at ``/embeddings``."""
    headers = {"Authorization": f"Bearer {key}"} if key else {}

    def ask(texts):
        rows = post(url.rstrip("/") + "/embeddings", {"model": model, "input": texts}, headers)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]

    return lambda texts: _in_batches(texts, ask)


def typed_embedder(url: str, model: str, key: str | None = None, input_type: str = "search_document", post: Post = post_json) -> Callable[[list[str]], list[list[float]]]:
    """Services that answer ``{"embeddings": {"float": [...]}}`` (or a bare list) to ``{"model", "texts", "input_type"}`` at ``/embed``."""
    headers = {"Authorization": f"Bearer {key}"} if key else {}

    def ask(texts):
        got = post(url.rstrip("/") + "/embed", {"model": model, "texts": texts, "input_type": input_type, "embedding_types": ["float"]}, headers)["embeddings"]
        return got["float"] if isinstance(got, dict) else got

    return lambda texts: _in_batches(texts, ask)
