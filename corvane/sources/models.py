"""Clients of model servers; they are pickled to executors and open connections there."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

RETRIED = {429, 502, 503, 504, 529}


def _post(url: str, payload: dict, token: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), headers), timeout=timeout) as r:
        return json.load(r)


@dataclass(frozen=True)
class Completion:
    """A chat completion server: one user message, the first choice's content."""

    base_url: str
    model_id: str = ""
    timeout: float = 600.0

    def call(self, prompt: str, temperature: float) -> str:
        payload = {"messages": [{"role": "user", "content": prompt}], "temperature": temperature, "cache_prompt": True}
        payload |= {"model": self.model_id} if self.model_id else {}
        try:
            answer = _post(f"{self.base_url.rstrip('/')}/v1/chat/completions", payload, None, self.timeout)
        except urllib.error.HTTPError as e:
            kind = ValueError if e.code == 400 else RuntimeError
            raise kind(f"model server answered {e.code}") from e
        return answer["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class Decisions:
    """A decision server: the prompt is a JSON object with ``state`` and ``questions``; the answer has ``answers``."""

    base_url: str
    model_id: str = ""
    token: str | None = None
    timeout: float = 600.0
    attempts: int = 3

    def call(self, prompt: str, temperature: float) -> str:
        payload = json.loads(prompt) | ({"model": self.model_id} if self.model_id else {})
        for attempt in range(1, self.attempts + 1):
            try:
                answer = _post(f"{self.base_url.rstrip('/')}/v1/systemone", payload, self.token, self.timeout)
                break
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or attempt == self.attempts:
                    raise
            except OSError:
                if attempt == self.attempts:
                    raise
            time.sleep(min(60.0, 0.5 * 2 ** (attempt - 1) * (0.5 + random.random())))
        if not isinstance(answer.get("answers"), dict):
            raise ValueError("the answer has no object 'answers'")
        return json.dumps(answer)


def choice(instructions: str, criteria: dict[str, str]) -> dict:
    """A question with named options; one without a name or a text is an error."""
    if not criteria or any(not k.strip() or not v.strip() for k, v in criteria.items()):
        raise ValueError("every option needs a name and a text")
    return {"type": "choice", "instructions": instructions, "criteria": dict(criteria)}


@dataclass(frozen=True)
class Function:
    """A plain function from a prompt and a temperature to an answer, as a client."""

    of: Callable[[str, float], str]
    model_id: str = "function"

    def call(self, prompt: str, temperature: float) -> str:
        return self.of(prompt, temperature)


@dataclass(frozen=True)
class Concurrent:
    """A client that several threads of a task may call, a few at a time, for servers that answer in parallel."""

    inner: object
    at_once: int = 10

    @property
    def model_id(self) -> str:
        return self.inner.model_id

    def call(self, prompt: str, temperature: float) -> str:
        return self.inner.call(prompt, temperature)

    def call_many(self, requests: list[tuple[str, float]]) -> list[str]:
        """Answers in the order of the requests."""
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(lambda r: self.inner.call(*r), requests))
