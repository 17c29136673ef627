"""Byte-level BPE by a traversal of the trie of distinct words.

The last token of a word's encoding is a state of the word's prefix: it is the
one token that ends there and may stand after the last token of the prefix
before it. So the states of a trie of words follow from those nearer its root,
each computed once for all words below, and a word's encoding is read back
from its leaf. Two tokens may stand side by side if no merge over their
border comes before both are complete.

Distinct words of a batch are inserted into the trie by sorting them: sorted
words are the trie's depth-first order, the bytes a word shares with the one
before are the path already walked, and the path's states are the stack.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from tessera.llm.common import Kept, keyed, slices, unkeyed

_PLAIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Words of these characters are cut here; others by the library's own pre-tokenizer.
_KNOWN = re.compile(rf"[\x00-\x08\x0e-\x1b\x21-\x7f {_PLAIN}\t\n\r]*")
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_PLAIN}]+| ?[0-9]+| ?[^ \t\n\r0-9{_PLAIN}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_CHUNK = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 for itself, the others from 256 upwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    def __init__(self, path: str, limit: int = 250_000) -> None:
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or spec["model"].get("ignore_merges"):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        self.letters = byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        raw = {t: bytes(self.letters[c] for c in t) for t in vocab}
        self.ids = {raw[t]: i for t, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        self.size = {i: len(b) for b, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {}
        for r, (a, b) in enumerate(pairs):
            self.parts.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.spine: tuple[dict, dict] = ({}, {})
        self.beside: dict[int, bool] = {}
        self.words, self.limit = Kept(limit), limit
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens that are in turn at the left (0) or right (1) edge of t while it grows, with the rank that ends each."""
        got = self.spine[side].get(t)
        if got is None:
            got, end, x = [(t, float("inf"))], None, t
            while x in self.parts:
                end, x = self.parts[x][0], self.parts[x][1 + side]
                got.append((x, end))
            self.spine[side][t] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        key = a << 32 | b
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) > 3 * self.limit:
                self.beside.clear()
            rank, got = self.rank, True
            for x, x_end in self._edge(a, 1):
                for y, y_end in self._edge(b, 0):
                    m = rank.get((x, y))
                    if m is not None and m < x_end and m <= y_end:
                        got = False
                        break
                if not got:
                    break
            self.beside[key] = got
        return got

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pre-tokens, by one walk over their trie."""
        out, find, known, fits, longest, size = {}, self.ids.get, self.beside.get, self.fits, self.longest, self.size
        path, last = b"", [-1]  # last[i]: last token of the first i bytes
        for w in sorted(words):
            same = 0
            for x, y in zip(path, w, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                # one token fits, so any order finds it: first the last one with a byte more, then short ones
                grown = i - 1 - size[last[i - 1]] if i > 1 else 0
                t = find(w[grown:i])
                if t is None or not ((known(last[grown] << 32 | t) or fits(last[grown], t)) if grown else self.alone(t)):
                    for at in range(i - 1, max(-1, i - 1 - longest), -1):
                        t = find(w[at:i])
                        if t is not None and at != grown and ((known(last[at] << 32 | t) or fits(last[at], t)) if at else self.alone(t)):
                            break
                    else:
                        raise ValueError("a byte without a token")
                last.append(t)
            path, got, i = w, [], len(w)
            while i:
                t = last[i]
                got.append(t)
                i -= size[t]
            got.reverse()
            out[w] = got
        return out

    def alone(self, t: int) -> bool:
        """Whether t is the encoding of its own bytes: its two parts never part before."""
        if t not in self.parts:
            return True
        _, a, b = self.parts[t]
        key = -1 - t
        got = self.beside.get(key)
        if got is None:
            x, y, whole = a, b, self.rank[(a, b)]
            got = self.alone(a) and self.alone(b)
            if got:  # no earlier merge over the border
                for p, p_end in self._edge(x, 1):
                    for q, q_end in self._edge(y, 0):
                        m = self.rank.get((p, q))
                        if m is not None and m < min(p_end, whole) and m <= q_end and m < whole:
                            got = False
            self.beside[key] = got
        return got

    def pre_tokens(self, piece: str) -> list[bytes]:
        if _KNOWN.fullmatch(piece):
            return [x.encode() for x in _CUT.findall(piece)]
        letters = self.letters
        return [bytes(letters[c] for c in s) for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(piece)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; a null text has none. A special token's string is its id."""
        cut: list[list] = []
        whole: set[str] = set()  # pieces that are pre-tokens already
        for t in texts:
            pieces: list = []
            for part in self.special.split(t or "") if self.special else [t or ""]:
                if part in self.specials:
                    pieces.append(self.specials[part])
                elif _KNOWN.fullmatch(part):
                    found = _CUT.findall(part)
                    whole.update(found)
                    pieces.extend(found)
                elif part:
                    pieces.extend([part] if _ODD.search(part) else _CHUNK.findall(part))
            cut.append(pieces)
        met: set = set()
        for ps in cut:
            met.update(ps)
        new = self.words.missing(met)
        kept = self.words.young
        split = {p: [p.encode()] if p in whole else self.pre_tokens(p) for p in new if isinstance(p, str)}
        known = self.encode_words(list({w for ws in split.values() for w in ws}))
        for p, ws in split.items():
            kept[p] = array("i", known[ws[0]] if len(ws) == 1 else [i for w in ws for i in known[w]]).tobytes()
        for p in new:
            if isinstance(p, int):
                kept[p] = np.int32(p).tobytes()
        get = kept.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)), np.int32) for ps in cut]


class Decoder:
    """Ids back to text, by the vocabulary alone."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row. Null and empty texts have no ids; repeated rows stay repeated."""
    schema = StructType.fromDDL("k long, ids array<int>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = trie_encoder(tokenizer)
        for b in batches:
            for part in slices(b, 500):
                ids = enc.encode_batch(part["text"].to_pylist())
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = pa.array(np.concatenate(ids), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, flat).cast(arrow.field("ids").type)
                yield pa.RecordBatch.from_arrays([part["k"], lists], schema=arrow)

    return keyed(docs).mapInArrow(run, schema).select(unkeyed(), "ids")


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text): special tokens are kept, broken UTF-8 becomes U+FFFD; null ids give null."""
    schema = StructType.fromDDL("doc_id long, ids array<int>, text string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer)
        for b in batches:
            for part in slices(b, 500):
                lists = part["ids"]
                flat, at = lists.flatten().to_numpy(), 0
                texts: list[str | None] = []
                for n in lists.value_lengths().to_pylist():
                    texts.append(None if n is None else decoder.decode(flat[at : at + n].tolist()))
                    at += n or 0
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(texts, pa.string())], schema=arrow)

    return rows.select("doc_id", F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, schema)
