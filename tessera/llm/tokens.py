"""Token ids as the tokenizers library gives them, by a faster coder.

The library spends most of its time on objects that nobody asks for. For two
kinds of tokenizer the same ids come from tiktoken, whose merges follow the
ranks that are read from the tokenizer's own file: byte-level BPE, and BPE
with word ends over lower-cased words. There a word's end is one more byte,
0x01, which the cheapest merges join to the byte before it. What these do not
cover is encoded whole by the library: other kinds of tokenizer, texts with
characters on whose class, case or form the libraries could differ, and very
long runs without a boundary.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from tessera.llm.bpe import byte_letters

#: Letters that all libraries lower-case alike and none composes (the dotted I and the apostrophe n go).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ɏ"
#: Those of them that are still among them in lower case: some capitals leave.
_STAYING = "".join(c for c in map(chr, range(0x80, 0x250)) if re.fullmatch(f"[{_LETTERS}]", c) and re.fullmatch(f"[{_LETTERS}]+", c.lower()))
#: What the word-end coder covers: those letters, ASCII but for 0x01 and the rarer spaces, common signs.
_COVERED = re.compile(rf"[\t\n\r\x00\x02-\x08\x0e-\x1b\x20-\x7f{_STAYING}¡¿«»°§–—‘’“”…]*")
#: Texts of these need no search for odd characters.
_SAFE = re.compile(r"[\t\n\r\x00-\x08\x0e-\x1b\x20-\x7f¡-¬®-ɏ–—‘’“”…]*")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\r0-9{_LETTERS}]+").findall
#: On these white spaces, and on letters newer than its tables, a library may differ from another.
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]|[^\x00-￿]")
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs from this length on go to the library, whose work on them does not grow with their square.
LONG = 50_000
_SPACES = re.compile(rf"\s{{{LONG}}}")


def has_run(text: str) -> bool:
    """Whether ``LONG`` characters in a row are white space, or none is."""
    if len(text) < LONG:
        return False
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) >= LONG or (len(text) - sum(sizes) - len(sizes) >= LONG - 2 and _SPACES.search(text) is not None)


class _Words:
    """Ids of words that each stand alone; up to ``MOST`` of ordinary length are remembered, a text's others are coded at once."""

    MOST = 200_000

    def __init__(self, coder: tiktoken.Encoding, ranks: dict[bytes, int]) -> None:
        self.coder, self.known = coder, {}
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for b, i in ranks.items() if b.endswith(b"\x01")]] = True

    def encode(self, words: list[str]) -> bytes:
        got = list(map(self.known.get, words))
        if None in got:
            new = list({w for w, g in zip(words, got, strict=True) if g is None})
            ids = self.coder.encode_to_numpy("\x01".join(new) + "\x01", disallowed_special=()).astype("<u4", copy=False)
            at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            raw = ids.tobytes()
            own = {w: raw[i:j] for w, i, j in zip(new, at[:-1], at[1:], strict=True)}
            got = [own[w] if g is None else g for w, g in zip(words, got, strict=True)]
            if len(self.known) < self.MOST:
                self.known.update((w, i) for w, i in own.items() if len(w) <= 64)
        return b"".join(got)


class Encoder:
    """``encode_batch(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.kind = self._kind(spec)
        specials = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)").search
        self.coder = None
        if self.kind:
            ranks = self._ranks(spec)
            if ranks:
                pattern = _BYTE_LEVEL if self.kind == "bytes" else r"[^\x01]+\x01"
                self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
                self.words = _Words(self.coder, ranks)  # no merge crosses a word's end, so a word has the same ids everywhere

    @staticmethod
    def _kind(spec: dict) -> str:
        """``bytes``, ``words`` or nothing."""
        pre, model, forms = spec["pre_tokenizer"] or {}, spec["model"], spec["normalizer"] or {}
        if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return ""
        if any(x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"] for x in spec["added_tokens"]):
            return ""
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not forms and not model.get("end_of_word_suffix"):
            return "bytes"
        parts = pre.get("pretokenizers") or []
        cut = len(parts) == 2 and parts[0].get("type") == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and parts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        level = cut and parts[1].get("type") == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        steps = [x["type"] for x in forms.get("normalizers", [])]
        return "words" if level and steps == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") else ""

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        """Bytes to ids, if the order of ids is that of the merges and every token is the encoding of its own bytes."""
        letters, end = byte_letters(), spec["model"].get("end_of_word_suffix") or ""
        specials = {x["content"] for x in spec["added_tokens"]}
        tokenize, out = self.tok.model.tokenize, {}
        for token, i in spec["model"]["vocab"].items():
            if token in specials:
                continue
            closed = bool(end) and token.endswith(end)
            body = token[: -len(end)] if closed else token
            if (closed or not end) and [x.id for x in tokenize(body)] != [i]:
                return None
            out[bytes(letters[c] for c in body) + (b"\x01" if closed else b"")] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in pairs]
        first = 256 * (2 if end else 1)
        return out if made == sorted(made) and (not made or made[0] >= first) and len(set(out.values())) == len(out) else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """A null text is empty."""
        text = text or ""
        if self.coder is None or self.special(text) or has_run(text):
            return self._whole(text)
        if self.kind == "words":
            if not _COVERED.fullmatch(text):
                return self._whole(text)
            return self.words.encode(_WORDS(text.lower()))
        if not _SAFE.fullmatch(text) and _ODD.search(text):
            return self._whole(text)
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
