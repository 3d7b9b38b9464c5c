"""Language-model clients: an OpenAI-compatible service, and a canned one for tests."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterable


def joined_chunks(lines: Iterable[bytes | str]) -> str:
    """The answer of a streamed reply: the contents of its events, one after the other, up to the end mark."""
    out = []
    for line in lines:
        line = line.decode() if isinstance(line, bytes) else line
        if not line.startswith("data:"):
            continue
        event = line[5:].strip()
        if event == "[DONE]":
            break
        for choice in json.loads(event).get("choices", [])[:1]:
            out.append(choice.get("delta", {}).get("content") or "")
    return "".join(out)


def http_client(base_url: str, api_key: str = "", timeout: float = 120.0, stream: bool = False):
    """A client of an OpenAI-compatible chat service; the retry policy is the caller's."""

    def client(system: str, user: str, params: dict) -> str | None:
        body = {k: v for k, v in params.items() if k != "extra_body"} | params.get("extra_body", {})
        body["messages"] = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        if stream:
            body["stream"] = True
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return joined_chunks(answer) if stream else json.load(answer)["choices"][0]["message"]["content"]

    return client


def retrying(client, attempts: int = 20, pause: float = 2.0):
    """For data generation: try again after a pause, None in the end."""
    import time

    def patient(system: str, user: str, params: dict) -> str | None:
        for k in range(attempts):
            try:
                if (answer := client(system, user, params)) is not None:
                    return answer
            except Exception:  # a remote service may fail in any way
                pass
            if k + 1 < attempts:
                time.sleep(pause)
        return None

    return patient


def canned():
    """Answers with the prompt's longest word; an odd prompt's first attempt gives no JSON."""

    def client(system: str, user: str, params: dict) -> str | None:
        if len(user) % 2 and params.get("seed") == 42:
            return "no json"
        word = max(user.split(), key=len, default="").replace("\\", "").replace('"', "")
        return json.dumps({"keywords": [["r", word, 0.9]]}, ensure_ascii=False)

    return client


def canned_pairs():
    """Answers with a chosen and a rejected extraction of the prompt's longest word; none for prompts with the word ``silence``."""

    def client(system: str, user: str, params: dict) -> str | None:
        if "silence" in user:
            return None
        word = max(user.split(), key=len, default="").replace("\\", "").replace('"', "").replace("<", "").replace("{", "").replace("}", "")
        chosen, rejected = (json.dumps({"keywords": [["r", w, 0.9]]}, ensure_ascii=False) for w in (word, word[::-1]))
        return f"<chosen>{chosen}</chosen>\n<rejected>{rejected}</rejected>"

    return client
