"""Asking a language model over HTTP."""

from __future__ import annotations

import json
import urllib.error
import urllib.request

# fixed values: the local model server's address, endpoint, default model and time limit
URL, ENDPOINT, MODEL, TIMEOUT = "http://127.0.0.1:11434", "/api/generate", "llama3.1", 120.0
#: manual: the prompt is shown and a person asks; ollama: it is sent to the local server.
PROVIDERS = ("manual", "ollama")


class Unavailable(RuntimeError):
    """The model server did not answer."""


def provider(name: str | None) -> str:
    """A known provider's name; manual where none is set."""
    found = (name or PROVIDERS[0]).casefold()
    if found not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}; known are {' and '.join(PROVIDERS)}")
    return found


def ask(prompt: str, model: str | None = None, url: str | None = None, timeout: float = TIMEOUT) -> str:
    """The model's answer to a prompt, whole."""
    body = {"model": model or MODEL, "prompt": prompt, "stream": False}
    call = urllib.request.Request((url or URL).rstrip("/") + ENDPOINT, json.dumps(body, ensure_ascii=False).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as got:
            answer = json.load(got)
    except (urllib.error.URLError, OSError) as e:
        raise Unavailable(f"no answer from {call.full_url}") from e
    except ValueError as e:
        raise ValueError("the model server's answer is no JSON") from e
    if not isinstance(answer, dict) or not isinstance(answer.get("response"), str):
        raise ValueError("the model server's answer has no text")
    return answer["response"]
