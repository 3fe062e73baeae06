"""What the byte-level tokenizer does before its merges, from its JSON file."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import regex

# Fixed value: the public byte-level pattern. White space is spelt as the Unicode property.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

# Texts over this many characters are cut into pieces step by step, not in one list.
LONG_TEXT = 1 << 20
STEP = 1 << 16


def read_tokenizer(path: str) -> str:
    """The JSON of a byte-level tokenizer, refused where it holds steps that the
    operators here don't follow."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    return text


@lru_cache(4)
def special_ids(text: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}


@lru_cache(4)
def splitter(text: str) -> Callable[[str], Iterator[tuple[str | None, list[str]]]]:
    """A function from a text to its parts: (special token, []) or (None, pieces)."""
    find = regex.compile(PIECE)
    # As the library does, the longest of several special strings at a place is taken.
    marks = sorted(special_ids(text), key=len, reverse=True)
    special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def parts(doc: str) -> Iterator[tuple[str | None, list[str]]]:
        for k, part in enumerate(special.split(doc) if special and any(m in doc for m in marks) else [doc]):
            if k % 2:
                yield part, []
            elif len(part) <= LONG_TEXT:
                yield None, find.findall(part)
            else:
                matches = find.finditer(part)
                while step := [m.group() for m in islice(matches, STEP)]:
                    yield None, step

    return parts
