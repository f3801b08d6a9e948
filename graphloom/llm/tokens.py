"""Tokenizer files and what tasks make of them.  A path is a parameter; nothing is copied into the repository."""

from __future__ import annotations

import base64
import json
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

# The characters of property White_Space (what \s means to the tokenizer's own pattern engine).
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
_SAFE_CUT = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")


def _held() -> dict[str, object]:
    """What this process has loaded.  It hangs on `sys`, as functions sent to a task bring globals of their own."""
    return sys.__dict__.setdefault("_graphloom_tokenizers", {})


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, the ids, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _printable() -> dict[int, str]:
    """Byte-level files name bytes by characters: those printable in Latin-1 by themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def _with_space(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))


PRETOKEN = _with_space(public_tokenizers.PATTERN)


def _split_pattern(path: str) -> tuple[regex.Pattern, dict[int, str]]:
    """The pre-token pattern of a file whose pre-tokenizer keeps a pattern's matches and then names bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if not (split["type"] == "Split" and split["invert"] and split["behavior"] == "Removed" and level["type"] == "ByteLevel" and not level["add_prefix_space"]):
        raise ValueError("another kind of pre-tokenizer")
    return _with_space(split["pattern"]["Regex"]), _printable()


def json_ranks(path: str) -> dict[bytes, int]:
    """The same of a byte-level BPE in a tokenizers file whose ids follow its merges, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in _printable().items()}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def encoding(path: str) -> tiktoken.Encoding:
    """Byte-level BPE from a rank file or a tokenizers file, without special tokens; loaded once per worker process."""
    held = _held()
    if path not in held:
        ranks = json_ranks(path) if path.endswith(".json") else read_ranks(path)
        held[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a tokenizers file finds in the raw text before anything else, and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("another kind of added token")
    return {t["content"]: t["id"] for t in added}


def around_added(encode: Callable[[str], np.ndarray], path: str) -> Callable[[str], np.ndarray]:
    """`encode` for what lies between the file's added tokens, which have their own ids wherever a text holds them."""
    added = added_tokens(path)
    if not added:
        return encode
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split

    def whole(text: str) -> np.ndarray:
        if not any(x in text for x in added):
            return encode(text)
        parts = split(text)
        return np.concatenate([np.array([added[x]], np.uint32) if k % 2 else encode(x) for k, x in enumerate(parts)])

    return whole


def byte_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids (uint32) by a byte-level BPE; a tokenizers file's added tokens count as in the tokenizers library."""
    e = encoding(path)

    def encode(text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *[e.encode_to_numpy(s, allowed_special=set(), disallowed_special=()) for s in slices(text)]])

    return around_added(encode, path) if path.endswith(".json") else encode


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of about `size`, cut only in front of white space, where pre-tokens always end."""
    at = 0
    while len(text) - at > size:
        m = _SAFE_CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:] if at else text


OLD = "\u0500"  # the letters and digits below are the same in all Unicode versions in use


def word_encoder(path: str, limit: int = 1 << 19) -> Callable[[str], np.ndarray]:
    """Text to ids (uint32) by a tokenizers file that drops white space, its added tokens as in the tokenizers library.

    No token crosses white space, so a text is cut at spaces and line feeds.  Pieces that the process met before come from a
    table of at most `limit` entries.  New ones go together, a NUL between them, through the file's normalizer and its pattern, and each
    pre-token not met before, its bytes as printable characters, through its model; pieces of later scripts, whose letters
    pattern engines of different Unicode versions see differently, go through the library's own encoder.
    """
    held = _held()
    if path not in held:
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        held[path] = t, *_split_pattern(path), {}, {}
    t, pattern, printable, known, merged = held[path]
    normalize, split, merge = t.normalizer.normalize_str, pattern.findall, t.model.tokenize

    def ids(found: list[str]) -> bytes:
        for x in found:
            if x not in merged:
                raw = x.encode("utf-8", "surrogatepass").decode("latin-1").translate(printable)
                merged[x] = array("I", [y.id for y in merge(raw)]).tobytes()
        return b"".join(map(merged.__getitem__, found))

    def learn(pieces: list[str]) -> None:
        for s in range(0, len(pieces), 4096):
            part = pieces[s : s + 4096]
            plain = normalize(" \0 ".join(part)).split(" \0 ")
            for p, q in zip(part, plain, strict=True):
                word = q.rstrip(".,")
                if word.isalpha():  # a word, with or without such marks behind it: what the pattern would find
                    known[p] = ids([word, q[len(word) :]] if len(word) < len(q) else [word])
                else:
                    known[p] = ids(split(q))

    def encode(text: str) -> np.ndarray:
        pieces = text.replace("\n", " ").split(" ")
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > limit:
                known.clear()
                new = set(pieces)
            if len(merged) > limit:
                merged.clear()
            usual = [p for p in new if p and "\0" not in p and max(p) < OLD and not p.isspace()]
            learn(usual)
            for p in new.difference(usual):
                known[p] = array("I", t.encode(p, add_special_tokens=False).ids).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.uint32)

    return around_added(encode, path)
