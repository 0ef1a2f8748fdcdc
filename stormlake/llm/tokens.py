"""Token ids of whole Arrow batches, by tokenizer files that are a parameter.

Both kinds of tokenizer here never join what stands before a space with the space itself, so a text
is cut at such places and every distinct segment is encoded once: a worker keeps the ids
of the last ``REMEMBERED`` segments by 64-bit hash. A tokenizer without that property gets
whole texts. Files are read on the driver and broadcast, a few megabytes each by their
format, so executors need no copy of them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from stormlake.llm.words import Words

#: segments whose ids a worker keeps, some 40 bytes each
REMEMBERED = 1 << 19

#: fixed value: how the byte-level pre-tokenizer cuts a text
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: letters below this have been letters in every version of Unicode that a library may hold
_SETTLED = "ɀ"


class Segments(Words):
    """Texts cut before every space that follows a character other than white space.

    Control characters, a few others that share bytes with wide spaces, and the sign that stands for
    a space in pieces count as white space here: fewer cuts are never wrong.
    """

    def __init__(self, texts: pa.Array, cut: bool = True):
        texts = texts.cast(pa.large_string()).fill_null("")
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.raw = self.data = raw = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        at = np.flatnonzero((raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] != 127)) + 1 if cut else np.zeros(0, np.int64)
        wide = raw[at - 1] >= 128
        last, two, three = raw[at - 1], raw[at - 2], raw[np.maximum(at - 3, 0)]
        unsure = (two == 0xC2) & ((last == 0x85) | (last == 0xA0))
        unsure |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
        unsure |= (three == 0xE2) & (two == 0x96) & (last == 0x81)
        opens = np.zeros(len(raw) + 1, dtype=bool)
        opens[at[~(wide & unsure)]] = True
        opens[self.offsets[:-1]] = True
        self.start = np.flatnonzero(opens[:-1])
        self.end = np.append(self.start[1:], len(raw))[: len(self.start)]
        self.first = np.searchsorted(self.start, self.offsets)


class ByteBpe:
    """A byte-level BPE in the JSON form of ``tokenizers``; ``special`` says whether special tokens are found in texts."""

    def __init__(self, raw: bytes, special: bool):
        self.tokenizer = Tokenizer.from_buffer(raw)
        self.tokenizer.encode_special_tokens = not special
        made = json.loads(raw)
        self.special = [token["content"] for token in made["added_tokens"]] if special else []
        alphabet = {c: bytes([b]) for b, c in _byte_letters().items()}
        vocabulary = made["model"]["vocab"]
        self.pieces = [b""] * (1 + max([*vocabulary.values(), *(token["id"] for token in made["added_tokens"])]))
        for token in made["added_tokens"]:
            self.pieces[token["id"]] = token["content"].encode()
        for token, number in vocabulary.items():
            if all(c in alphabet for c in token):
                self.pieces[number] = b"".join(alphabet[c] for c in token)
        before = made["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex") and not made["normalizer"] and not before.get("add_prefix_space")
        added = {token["content"] for token in made["added_tokens"]}
        self.ranked = self._ranked({t: n for t, n in vocabulary.items() if t not in added}, made["model"]) if self.cuts else None

    def _ranked(self, vocabulary: dict, model: dict):
        """The faster library, where merges stand in the order of the ids that they make: then results are equal."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        plain = len(made) + 256 == len(vocabulary) and made == sorted(made) and not model.get("ignore_merges") and not model.get("dropout")
        if not plain or (made and made[0] < 256):
            return None
        ranks = {self.pieces[number]: number for number in vocabulary.values()}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.ranked:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ranked = self.ranked.encode_ordinary
        found = [ranked(t) if t.isascii() or max(t) < _SETTLED else None for t in texts]
        for special in self.special:
            found = [None if special in t else ids for t, ids in zip(texts, found)]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        return found


class PieceBpe:
    """A SentencePiece model; it puts a space before each text, so it takes texts without that one."""

    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [
            b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(name[3:5], 16)]) if self.model.is_byte(i)
            else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.cuts = not any("▁" in name.lstrip("▁") for name in names)
        self.space = self.model.encode("x ")[len(self.model.encode("x")) :]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids or self.space for ids in found]


def _byte_letters() -> dict[int, str]:
    """Byte-level letters: printable Latin bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """Ids of segments, each distinct one encoded once."""

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = tokenizer, remembered
        self.sizes = np.array([len(p) for p in tokenizer.pieces], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(tokenizer.pieces), dtype=np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def encode(self, segments: Segments, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where those of each segment begin (one more at the end)."""
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > self.remembered:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            raw, spans = segments.raw.tobytes(), zip(segments.start[at[new]].tolist(), segments.end[at[new]].tolist())
            found = self.tokenizer.encode([raw[a:b].decode() for a, b in spans])
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, counts.sum())
            self.known = np.insert(self.known, place[new], distinct[new])
            self.entry = np.insert(self.entry, place[new], len(self.first) - 1 + np.arange(len(new)))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, flat])
            place = np.searchsorted(self.known, distinct)
        entry = self.entry[place][back.ravel()] if len(distinct) else np.zeros(0, np.int64)
        begins, counts = self.first[entry], self.first[entry + 1] - self.first[entry]
        first = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ranges(begins, counts)], first


def ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``begins[i], begins[i] + 1, ...``, ``counts[i]`` numbers each, one after the other."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


def worker_kept(key, make: Callable):
    """What ``make`` gives, kept as long as the Python worker lives.

    Code of this subpackage travels with each job and has no lasting globals of its own.
    """
    kept = sys.modules.setdefault("_stormlake_kept", ModuleType("_stormlake_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
