"""Models behind small protocols: over HTTP, or offline and deterministic."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.batches import pieces
from tessella.functions.text import STOP_WORDS

ZERO_DIM = 768


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> list[str]: ...


class Classifier(Protocol):
    def classify(self, texts: Sequence[str]) -> list[str]: ...


class ProviderError(RuntimeError):
    """A service failed or sent something else than expected."""


def _post(url: str, body: dict, timeout: float, method: str = "POST") -> dict:
    data = None if method == "DELETE" else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            raw = r.read()
    except OSError as e:
        raise ProviderError(f"request failed: {e}") from e
    return parse_body(raw.decode("utf-8", "replace")) if raw else {}


def parse_body(raw: str) -> dict:
    try:
        out = json.loads(raw)
    except ValueError as e:
        raise ProviderError("the answer is not JSON") from e
    if not isinstance(out, dict):
        raise ProviderError("the answer is no object")
    if "error" in out:
        raise ProviderError(f"the service reports: {out['error']}")
    return out


def embedding_of(body: dict) -> list[float]:
    v = body.get("embedding")
    if not isinstance(v, list) or not all(isinstance(x, (int, float)) for x in v):
        raise ProviderError("the answer has no embedding")
    return [float(x) for x in v]


def text_of(body: dict) -> str:
    """The first candidate's first part."""
    try:
        return body["candidates"][0]["content"]["parts"][0]["text"]
    except (KeyError, IndexError, TypeError) as e:
        raise ProviderError("the answer has no text") from e


def each(call: Callable[[object], object], items: Sequence, at_once: int) -> list:
    """The answers in order, with so many calls in flight. The first failure is raised once none is."""
    if at_once <= 1 or len(items) < 2:
        return [call(x) for x in items]
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        return list(pool.map(call, items))


class HttpEmbedder:
    """POST {model, prompt}, answered by {embedding: [...]}."""

    def __init__(self, url: str, model: str, timeout: float = 60, at_once: int = 8):
        self.url, self.model, self.timeout, self.at_once = url, model, timeout, at_once

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return each(lambda t: embedding_of(_post(self.url, {"model": self.model, "prompt": t}, self.timeout)), texts, self.at_once)


class HttpGenerator:
    """POST <base>/models/<model>:generateContent, answered by {candidates: [...]}; and cached contents."""

    def __init__(self, base: str, model: str, key: str, cached_model: str | None = None, timeout: float = 60, at_once: int = 8):
        self.base, self.model, self.key, self.cached_model, self.timeout, self.at_once = base.rstrip("/"), model, key, cached_model or model, timeout, at_once

    def _call(self, model: str, body: dict) -> str:
        return text_of(_post(f"{self.base}/models/{model}:generateContent?key={self.key}", body, self.timeout))

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return each(lambda p: self._call(self.model, {"contents": [{"parts": [{"text": p}]}]}), prompts, self.at_once)

    def create_cached(self, text: str, ttl: str = "300s") -> str:
        body = {"model": f"models/{self.cached_model}", "contents": [{"role": "user", "parts": [{"text": text}]}], "ttl": ttl}
        name = _post(f"{self.base}/cachedContents?key={self.key}", body, self.timeout).get("name")
        if not name:
            raise ProviderError("the answer has no name")
        return name

    def generate_cached(self, name: str, prompt: str) -> str:
        return self._call(self.cached_model, {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "cachedContent": name})

    def delete_cached(self, name: str) -> None:
        """As far as it goes: a failure is ignored."""
        try:
            _post(f"{self.base}/{name}?key={self.key}", {}, self.timeout, "DELETE")
        except ProviderError:
            pass


def verdict(response: str | None) -> str:
    """``safe`` only if the answer is just that."""
    return "safe" if (response or "").strip().lower() == "safe" else "unsafe"


class HttpClassifier:
    """POST {model, prompt, stream: false}, answered by {response: ...}."""

    def __init__(self, url: str, model: str, prompt: str = "{query}", timeout: float = 60, at_once: int = 8):
        self.url, self.model, self.prompt, self.timeout, self.at_once = url, model, prompt, timeout, at_once

    def classify(self, texts: Sequence[str]) -> list[str]:
        return each(lambda t: verdict(_post(self.url, {"model": self.model, "prompt": self.prompt.format(query=t), "stream": False}, self.timeout).get("response")), texts, self.at_once)


_STOP_WORDS, _TOKENS = frozenset(STOP_WORDS), re.compile(r"[a-z0-9]{2,}").findall
#: Tokens whose bucket an embedder remembers.
TOKENS_HELD = 50_000


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")


class _Buckets(dict):
    """Token to bucket, found when it is first asked for; stop words have bucket ``dim``. Begins anew when it holds TOKENS_HELD."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS_HELD:
            self.clear()
        self[token] = found = self.dim if token in _STOP_WORDS else _token_hash(token) % self.dim
        return found


class HashEmbedder:
    """Offline: index tokens counted into ``dim`` buckets by their md5, scaled to length 1; zeros for none."""

    def __init__(self, dim: int = 64):
        self.dim, self.buckets = dim, _Buckets(dim)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"buckets": _Buckets(self.dim)}  # tasks remember their own

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        tokens = _TOKENS((text or "").lower())
        places = np.fromiter(map(self.buckets.__getitem__, tokens), np.int64, len(tokens))
        v = np.bincount(places, minlength=self.dim + 1)[: self.dim].tolist()
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else [0.0] * self.dim


class EchoGenerator:
    """Offline: answers with a function of the prompt, by default its last line."""

    def __init__(self, answer: Callable[[str], str] | None = None):
        self.answer = answer or (lambda p: p.strip().split("\n")[-1])

    def generate(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


def first_passage(prompt: str) -> str:
    """The first line of a grounded prompt's first passage; '' for another prompt."""
    return prompt.split("\n[1] ", 1)[1].split("\n", 1)[0].strip() if "\n[1] " in prompt else ""


class ConstantClassifier:
    def __init__(self, answer: str = "safe"):
        self.answer = answer

    def classify(self, texts: Sequence[str]) -> list[str]:
        return [verdict(self.answer) for _ in texts]


def in_batches(ask: Callable[[list], list], items: list) -> list[tuple[object, str | None]]:
    """(answer, error) for each item. The service gets all at once; a batch that fails is halved until what fails is alone."""
    if not items:
        return []
    try:
        answers = list(ask(items))
        if len(answers) != len(items):
            raise ProviderError(f"{len(answers)} answers to {len(items)} inputs")
        return [(x, None) for x in answers]
    except Exception as e:
        if len(items) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(items) // 2
    return in_batches(ask, items[:half]) + in_batches(ask, items[half:])


#: Inputs that go to a service at once.
AT_ONCE = 256


def asked(ask: Callable[[list], list], items: list) -> list[tuple[object, str | None]]:
    return [x for lo in range(0, len(items), AT_ONCE) for x in in_batches(ask, items[lo : lo + AT_ONCE])]


def try_embed_udf(embedder: Embedder) -> Callable[[Column], Column]:
    """struct<vector, error>: the vector can be empty, if the service says so; it is null for null and blank texts and after an error."""

    @F.arrow_udf("struct<vector:array<double>,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (s,) in pieces(batches):
            rows = s.to_pylist()
            got = iter(asked(embedder.embed, [t for t in rows if t and t.strip()]))
            found = [next(got) if t and t.strip() else (None, None) for t in rows]
            vectors = pa.array([None if v is None else [float(x) for x in v] for v, _ in found], pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([vectors, pa.array([e for _, e in found], pa.string())], names=["vector", "error"])

    return run


def embed_udf(embedder: Embedder) -> Callable[[Column], Column]:
    """Vectors by the embedder, a batch at a time; null for null, blank and failed texts.

    Not deterministic for Spark: a filter on vectors isn't pushed below, where it asks the model again in
    Python workers of its own. So a column that names the vector twice must do so by a column's name.
    """
    run = try_embed_udf(embedder).asNondeterministic()
    return lambda text: run(text)["vector"]


def generate_udf(generator: Generator) -> Callable[[Column], Column]:
    """Answers by the generator, a batch at a time; '' where it fails."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (s,) in pieces(batches):
            yield pa.array([str(x or "").strip() for x, _ in asked(generator.generate, s.to_pylist())], pa.string())

    return run


def classify_udf(classifier: Classifier) -> Callable[[Column], Column]:
    """``safe`` or ``unsafe``, a batch at a time; a failure is unsafe."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (s,) in pieces(batches):
            yield pa.array(["unsafe" if e else x for x, e in asked(classifier.classify, [t or "" for t in s.to_pylist()])], pa.string())

    return run


def or_zero(vector: Column, dim: int = ZERO_DIM) -> Column:
    """The vector, or zeros where it is null or empty."""
    return F.when(F.size(vector) > 0, vector).otherwise(F.array_repeat(F.lit(0.0), dim))
