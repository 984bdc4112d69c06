"""Public vocabulary files: read once on the driver, shared with the tasks."""

from __future__ import annotations

import base64
import functools
import json


def read_ranks(path: str) -> bytes:
    """A rank file (about a megabyte) as it is, so that executors need no file of their own."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def read_added(path: str) -> tuple[tuple[str, int], ...]:
    """(text, id) of the added tokens of a tokenizer file; its library recognises them inside texts."""
    with open(path, encoding="utf-8") as file:
        return tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])


@functools.lru_cache(maxsize=2)
def encoding(content: bytes, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """The library encoder over a rank file, with the special tokens ``added``; one per worker."""
    import tiktoken
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=parse_ranks(content), special_tokens=dict(added))
