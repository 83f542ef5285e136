"""Answer providers: bounds of a configuration, and a client for a chat service that answers over HTTP."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlsplit

# Settings that may come from the environment, and the range of each number.
VARIABLES = {"provider": "RAG_LLM_PROVIDER", "model": "RAG_LLM_MODEL", "base_url": "RAG_LLM_BASE_URL", "timeout_seconds": "RAG_LLM_TIMEOUT_SECONDS", "max_evidence_chars": "RAG_MAX_EVIDENCE_CHARS", "max_chunks": "RAG_MAX_EVIDENCE_CHUNKS", "max_output_tokens": "RAG_LLM_MAX_OUTPUT_TOKENS", "max_response_bytes": "RAG_LLM_MAX_RESPONSE_BYTES"}
BOUNDS = {"timeout_seconds": (0, 600), "max_evidence_chars": (1, 200_000), "max_chunks": (1, 100), "max_output_tokens": (64, 16_384), "max_response_bytes": (1024, 1 << 20)}
PROVIDERS = ("ollama", "local")


class ProviderError(RuntimeError):
    """The service gave no usable reply. The message holds nothing of the request or the reply."""


@dataclass(frozen=True)
class GenerationConfig:
    model: str
    provider: str = "ollama"
    base_url: str = "http://localhost:11434"
    timeout_seconds: float = 60.0
    max_evidence_chars: int = 24_000
    max_chunks: int = 12
    max_output_tokens: int = 2048
    max_response_bytes: int = 131_072

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}; known are {', '.join(PROVIDERS)}")
        if not isinstance(self.model, str) or not self.model or self.model != self.model.strip():
            raise ValueError("a model needs a name without blanks at its ends")
        for name, (least, most) in BOUNDS.items():
            value = getattr(self, name)
            whole = name != "timeout_seconds"
            if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not (least <= value <= most if whole else least < value <= most):
                raise ValueError(f"{name} must be {'from' if whole else 'above'} {least} to {most}")
        url = urlsplit(self.base_url)
        extras = (url.username, url.password, url.query, url.fragment, url.path.strip("/"))
        if url.scheme not in ("http", "https") or not url.hostname or any(extras) or url.path not in ("", "/"):
            raise ValueError("the service's address must be scheme, host and port alone")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> GenerationConfig:
        env = os.environ if env is None else env
        kinds = {f.name: {"int": int, "float": float}.get(str(f.type), str) for f in fields(cls)}
        return cls(**({"model": ""} | {name: kinds[name](env[key]) for name, key in VARIABLES.items() if key in env}))


def read_envelope(raw: bytes, config: GenerationConfig) -> str:
    """The assistant's text of a complete reply within the byte limit."""
    if len(raw) > config.max_response_bytes:
        raise ProviderError("the reply is longer than the limit")
    try:
        reply = json.loads(raw)
    except ValueError:
        raise ProviderError("the reply is not JSON") from None
    if not isinstance(reply, dict) or reply.get("done") is not True:
        raise ProviderError("the reply is not complete")
    if reply.get("done_reason") == "length":
        raise ProviderError("the reply was cut at the token limit")
    message = reply.get("message")
    text = message.get("content") if isinstance(message, dict) and message.get("role") == "assistant" else None
    if not isinstance(text, str) or not text.strip():
        raise ProviderError("the reply has no text of the assistant")
    return text


class _Stay(urllib.request.HTTPRedirectHandler):
    """Evidence goes to no other address than the configured one."""

    def redirect_request(self, *_args):
        return None


def chat_client(config: GenerationConfig, schema: dict | None = None) -> Callable[[], Callable[[str, str], str]]:
    """A client for evidence.complete(): made once a worker, it asks a running service and changes nothing there."""

    def make() -> Callable[[str, str], str]:
        opener = urllib.request.build_opener(_Stay())

        def ask(system: str, user: str) -> str:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            body = {"model": config.model, "messages": messages, "stream": False, "options": {"temperature": 0, "num_predict": config.max_output_tokens}}
            body |= {"format": schema} if schema else {}
            request = urllib.request.Request(f"{config.base_url.rstrip('/')}/api/chat", json.dumps(body, ensure_ascii=False).encode(), {"Content-Type": "application/json"}, method="POST")
            try:
                with opener.open(request, timeout=config.timeout_seconds) as response:
                    raw = response.read(config.max_response_bytes + 1)
            except (OSError, urllib.error.URLError):
                raise ProviderError("the service cannot be asked; check its address and model") from None
            return read_envelope(raw, config)

        return ask

    return make
