"""A model endpoint over HTTP for the quality lane: chat completions in the widespread JSON form."""

from __future__ import annotations

import json
from collections.abc import Callable

from factloom.settings import Settings
from factloom.sources import web


class ChatEndpoint:
    """Callable ``(task, tier, prompts) -> [(result, input_tokens, output_tokens)]``; picklable, so executors call it.

    An answer that fails, is cut or has no text counts as a failure of that call alone.
    """

    def __init__(self, url: str, key: str, models: dict[str, str], timeout: float = 30.0, opener: Callable | None = None):
        self.url, self.key, self.models, self.timeout, self.opener = url.rstrip("/"), key, models, timeout, opener

    def __call__(self, task: str, tier: str, prompts: list[str]) -> list[tuple[str | None, int, int]]:
        return [self._one(self.models.get(tier) or self.models["cheap"], p) for p in prompts]

    def _one(self, model: str, prompt: str) -> tuple[str | None, int, int]:
        body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        r = web.fetch(f"{self.url}/chat/completions", headers, 1_000_000, self.timeout, opener=self.opener, body=body)
        if r["status"] != 200 or r["truncated"]:
            return None, 0, 0
        try:
            told = json.loads(r["body"])
            text, used = told["choices"][0]["message"]["content"], told.get("usage") or {}
        except (ValueError, KeyError, IndexError, TypeError):
            return None, 0, 0
        return (text.strip() or None) if isinstance(text, str) else None, int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0)


def endpoint(s: Settings) -> ChatEndpoint | None:
    """The endpoint that the settings name, or None: without an address, a key and a model there is none."""
    if not (s.model_url and s.api_key and s.model_id):
        return None
    return ChatEndpoint(s.model_url, s.api_key, {"cheap": s.model_id} | ({"strong": s.strong_model_id} if s.strong_model_id else {}))


def missing(s: Settings) -> list[str]:
    """Settings that an endpoint still needs."""
    return [n for n in ("model_url", "api_key", "model_id") if not getattr(s, n)]
