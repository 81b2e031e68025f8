"""Byte-level vocabularies: files are read on the driver and sent to the tasks as text (a few MB, fixed)."""

from __future__ import annotations

import hashlib
import json

#: A vocabulary file larger than this is refused: it is broadcast whole.
MAX_FILE_BYTES = 64 << 20


def byte_symbols() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[str, str]:
    """File text and its digest (the key under which a worker keeps the parsed form)."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return text, hashlib.sha256(text.encode()).hexdigest()


def parse(text: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """Token ids, merges in rank order, and special tokens with their ids."""
    spec = json.loads(text)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]}
