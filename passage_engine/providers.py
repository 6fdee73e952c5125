"""Models behind small protocols: embedders, language models, judges. Real ones plug in; the fakes are deterministic."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

from passage_engine.config import CloudSettings


class Embedder(Protocol):
    def open(self) -> None: ...

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class LanguageModel(Protocol):
    name: str

    def generate(self, prompt: str) -> str: ...


class Judge(Protocol):
    def judge(self, question: str, answer: str, contexts: Sequence[str], truth: str) -> dict[str, float | None]: ...


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashEmbedder:
    """Signed hashed word counts."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def open(self) -> None:
        pass

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", text.lower()):
                h = _word_hash(w)
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class CallableEmbedder:
    """Any function of texts; ``load`` makes it, once a partition."""

    def __init__(self, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]):
        self.load = load

    def open(self) -> None:
        self.encode = self.load()


class ScriptedModel:
    """Answers from a function of the prompt."""

    def __init__(self, reply: Callable[[str], str], name: str = "scripted:1"):
        self.reply, self.name = reply, name

    def generate(self, prompt: str) -> str:
        return self.reply(prompt)


class LocalServerModel:
    """A model behind a local HTTP server with a /api/generate end point."""

    def __init__(self, model: str = "mistral:7b", url: str = "http://localhost:11434", max_tokens: int = 500, timeout: float = 60, probe: float = 5):
        self.model, self.url, self.max_tokens, self.timeout, self.name = model, url.rstrip("/"), max_tokens, timeout, f"ollama:{model}"
        try:
            urllib.request.urlopen(f"{self.url}/api/tags", timeout=probe).close()
        except OSError as e:
            raise ValueError(f"no model server at {self.url}: {e}") from e

    def generate(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"num_predict": self.max_tokens}}
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["response"].strip()


class HostedModel:
    """A hosted chat deployment; ``client`` is any function (messages, max_tokens) -> text."""

    def __init__(self, client: Callable[[list[dict], int], str], model: str = "gpt-4", max_tokens: int = 2000):
        self.client, self.model, self.max_tokens, self.name = client, model, max_tokens, f"azure:{model}"

    def generate(self, prompt: str) -> str:
        return self.client([{"role": "user", "content": prompt}], self.max_tokens).strip()


def language_model(provider: str, model: str | None = None, client: Callable | None = None, **how) -> LanguageModel:
    """The model of a provider, with that provider's usual model where none is named."""
    if provider == "ollama":
        return LocalServerModel(model or "mistral:7b", **how)
    if provider == "azure":
        if client is None:
            missing = CloudSettings.from_env().missing()
            raise ValueError(f"a hosted model needs a client; settings not given: {', '.join(missing) or 'none'}")
        return HostedModel(client, model or "gpt-4", **how)
    raise ValueError(f"unknown provider {provider!r}")


class OverlapJudge:
    """Word-overlap stand-ins for the four judged metrics."""

    def judge(self, question: str, answer: str, contexts: Sequence[str], truth: str) -> dict[str, float | None]:
        words = lambda s: set(re.findall(r"\w+", s.lower()))
        a, q, t, c = words(answer), words(question), words(truth), words(" ".join(contexts))
        part = lambda x, y: len(x & y) / len(x) if x else None
        return {"answer_relevancy": part(q, a), "faithfulness": part(a, c), "context_precision": part(q, c), "context_recall": part(t, c)}
