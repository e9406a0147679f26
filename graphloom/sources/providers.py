"""Models behind small interfaces: embeddings, text generation, extraction.

Offline defaults are deterministic and need nothing; HTTP ones speak the common
chat and embedding protocols. A provider is sent to the workers, so it must be
picklable; connections are made there.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from graphloom.config import DEFAULTS, ENTITY_TYPES


class EmbeddingProvider(Protocol):
    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextProvider(Protocol):
    def complete(self, prompt: str) -> tuple[str | None, str | None]:
        """(text, error); never raises."""


class Extractor(Protocol):
    def extract(self, texts: list[str]) -> list[dict]:
        """For each text {"entities": [{name, type, description}], "relationships": [{source, target, type, description}]}, with "error" where it failed."""


@dataclass
class HashEmbedding:
    """Words hashed to signed places of a vector of length one; the same everywhere and always."""

    width: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = np.zeros((len(texts), self.width))
        for row, t in zip(out, texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                row[h % self.width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def _post(url: str, body: dict, timeout: float, key: str | None, more: dict[str, str] | None = None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}) | (more or {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
        return json.load(r)


@dataclass
class HttpEmbedding:
    """POST /v1/embeddings in batches, some in flight; tried three times, then it raises."""

    base_url: str
    model: str
    width: int
    key: str | None = None
    timeout: float = 120
    tries: int = 3
    pause: float = 2

    def _batch(self, texts: list[str]) -> list[list[float]]:
        for n in range(self.tries):
            try:
                data = _post(f"{self.base_url}/v1/embeddings", {"model": self.model, "input": texts}, self.timeout, self.key)["data"]
                return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
            except Exception:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**n)
        return []

    def embed(self, texts: list[str]) -> list[list[float]]:
        size = DEFAULTS.embedding_batch_size
        with ThreadPoolExecutor(DEFAULTS.embedding_concurrency) as pool:
            return [v for b in pool.map(self._batch, [texts[i : i + size] for i in range(0, len(texts), size)]) for v in b]


@dataclass
class HttpText:
    """POST /v1/chat/completions, with further headers where a host asks for them.

    ``usage_file`` collects the tokens of every call as lines of JSON, on the
    machine where the call was made.
    """

    base_url: str
    model: str
    key: str | None = None
    timeout: float = 600
    system: str | None = None
    headers: dict[str, str] | None = None
    usage_file: str | None = None

    def complete(self, prompt: str) -> tuple[str | None, str | None]:
        messages = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "temperature": DEFAULTS.llm_temperature, "max_tokens": DEFAULTS.llm_max_tokens}
        try:
            answer = _post(f"{self.base_url}/v1/chat/completions", body, self.timeout, self.key, self.headers)
            if self.usage_file:
                with open(self.usage_file, "a") as f:
                    f.write(json.dumps({"model": self.model} | (answer.get("usage") or {})) + "\n")
            return answer["choices"][0]["message"]["content"], None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"


def healthy(base_url: str, timeout: float = 5) -> bool:
    try:
        with urllib.request.urlopen(f"{base_url}/v1/models", timeout=timeout) as r:
            return r.status == 200
    except Exception:
        return False


def probe(text: TextProvider | None = None, embedding: EmbeddingProvider | None = None) -> dict[str, str]:
    """What live calls to the models give: "ok", or what went wrong."""
    out = {}
    if text is not None:
        reply, error = text.complete("Answer with the word ok.")
        out["text"] = error or ("ok" if reply else "empty reply")
    if embedding is not None:
        try:
            width = len(embedding.embed(["probe"])[0])
            out["embedding"] = "ok" if width == embedding.width else f"width {width} instead of {embedding.width}"
        except Exception as e:
            out["embedding"] = f"{type(e).__name__}: {e}"
    return out


@dataclass
class RuleExtractor:
    """Capitalised word runs as entities, neighbours in a sentence as relationships. A stand-in for a model."""

    most_entities: int = DEFAULTS.max_entities_per_chunk
    most_relationships: int = DEFAULTS.max_relationships_per_chunk

    def extract(self, texts: list[str]) -> list[dict]:
        return [self._one(t or "") for t in texts]

    def _one(self, text: str) -> dict:
        names: dict[str, None] = {}
        rels = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            own = [m[0] for m in re.finditer(r"\b[A-Z][\w&'-]*(?:\s+(?:of|de|von|&)?\s*[A-Z][\w&'-]*)+", sentence) if 1 < len(m[0]) < 50]
            names.update(dict.fromkeys(own))
            rels += [{"source": a, "target": b, "type": "RELATED_TO", "description": sentence[:200]} for a, b in zip(own, own[1:]) if a != b]
        kept = list(names)[: self.most_entities]
        return {"entities": [{"name": n, "type": "CONCEPT", "description": ""} for n in kept], "relationships": [r for r in rels if r["source"] in kept and r["target"] in kept][: self.most_relationships]}


@dataclass
class ModelExtractor:
    """Entities, then relationships, asked of a text model; replies are repaired, failures come back empty with an error.

    Entities of several texts are asked for at once, and ``at_once`` prompts are
    on their way at a time. Texts that a joint reply leaves out are asked for one
    by one.
    """

    model: TextProvider
    most_chars: int = 3000
    together: int = DEFAULTS.llm_chunks_per_batch
    at_once: int = DEFAULTS.llm_concurrency

    def extract(self, texts: list[str]) -> list[dict]:
        texts = [t or "" for t in texts]
        with ThreadPoolExecutor(self.at_once) as pool:
            groups = [texts[i : i + self.together] for i in range(0, len(texts), self.together)]
            found = [f for group in pool.map(self._entities, groups) for f in group]
            return list(pool.map(self._relationships, texts, found))

    def _entities(self, texts: list[str]) -> list[tuple[list[dict], str | None]]:
        """(entities, error) of each text."""
        if len(texts) == 1:
            return [self._entities_of(texts[0])]
        blocks = "\n\n".join(f"### TEXT {i}\n{t[: self.most_chars]}\n### END {i}" for i, t in enumerate(texts))
        reply, error = self.model.complete(f'List the entities of each of {len(texts)} texts as JSON keyed by the number of the text, {{"0": {{"entities": [{{"name", "type", "description"}}]}}, ...}}, types {", ".join(ENTITY_TYPES)}.\n\n{blocks}')
        if error:
            return [([], error)] * len(texts)
        found = _repaired(reply)
        return [(_cleaned(found[str(i)]), None) if isinstance(found.get(str(i)), dict) else self._entities_of(t) for i, t in enumerate(texts)]

    def _entities_of(self, text: str) -> tuple[list[dict], str | None]:
        reply, error = self.model.complete(f"List the entities of the text as JSON {{\"entities\": [{{\"name\", \"type\", \"description\"}}]}}, types {', '.join(ENTITY_TYPES)}.\n\n{text[: self.most_chars]}")
        return _cleaned(_repaired(reply)), error

    def _relationships(self, text: str, found: tuple[list[dict], str | None]) -> dict:
        entities, error = found
        if not entities:
            return {"entities": [], "relationships": [], "error": error}
        names = ", ".join(e["name"] for e in entities)
        reply, error = self.model.complete(f"List the relationships between {names} as JSON {{\"relationships\": [{{\"source\", \"target\", \"type\", \"description\"}}]}}.\n\n{text[: self.most_chars]}")
        rels = [clean_relationship(r) for r in _repaired(reply).get("relationships") or [] if isinstance(r, dict)]
        return {"entities": entities, "relationships": [r for r in rels if r][: DEFAULTS.max_relationships_per_chunk], "error": error}


@dataclass
class SpanExtractor:
    """Entities from a tagging model, relationships from a text model if there is one.

    ``predict(text, labels, threshold)`` gives spans {text, label, score}; the
    function is sent to the workers and loads its model there.
    """

    predict: Callable[[str, list[str], float], list[dict]]
    labels: list[str] = field(default_factory=lambda: [t.capitalize() for t in ENTITY_TYPES])
    threshold: float = 0.5
    model: TextProvider | None = None

    def extract(self, texts: list[str]) -> list[dict]:
        tagged = [self._tagged(t or "") for t in texts]
        if self.model is None:
            return [{"entities": e, "relationships": [], "error": error} for e, error in tagged]
        asked = ModelExtractor(self.model)
        with ThreadPoolExecutor(asked.at_once) as pool:
            return list(pool.map(asked._relationships, [t or "" for t in texts], tagged))

    def _tagged(self, text: str) -> tuple[list[dict], str | None]:
        try:
            spans = self.predict(text, self.labels, self.threshold)
        except Exception as e:
            return [], f"{type(e).__name__}: {e}"
        best: dict[str, dict] = {}
        for s in spans:
            name = " ".join(str(s["text"]).split())
            if 1 < len(name) < 50 and s.get("score", 1.0) >= self.threshold and s.get("score", 1.0) > best.get(name.lower(), {"score": -1.0})["score"]:
                best[name.lower()] = {"name": name, "type": s["label"], "score": s.get("score", 1.0)}
        return [clean_entity(e) for e in best.values()][: DEFAULTS.max_entities_per_chunk], None


def _repaired(reply: str | None) -> dict:
    from graphloom.functions.jsontools import repair_json

    found = repair_json(reply)
    return found if isinstance(found, dict) else {}


def _cleaned(found: dict) -> list[dict]:
    return [clean_entity(e) for e in found.get("entities") or [] if isinstance(e, dict)][: DEFAULTS.max_entities_per_chunk]


def clean_entity(e: dict) -> dict:
    kind = str(e.get("type") or "").upper()
    return {"name": str(e.get("name") or "Unknown"), "type": kind if kind in ENTITY_TYPES else "CONCEPT", "description": str(e.get("description") or "")}


def clean_relationship(r: dict) -> dict | None:
    """None without both ends: an empty name would match everything."""
    a, b = str(r.get("source") or "").strip(), str(r.get("target") or "").strip()
    return {"source": a, "target": b, "type": str(r.get("type") or "RELATED_TO").upper(), "description": str(r.get("description") or "")} if a and b else None
