"""Distinct-chunk tables: text is cut where no token can cross, each distinct chunk is encoded once.

A table lives in one worker, keeps the first ``most`` chunks it meets (frequent ones come early) and encodes
later rare ones batch by batch without keeping them, so its memory is bounded.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

MOST_CHUNKS = 400_000
LONGEST_KEPT = 64


def pack(ids: list[int], width: str = "<u4") -> bytes:
    """Little-endian unsigned integers of two or four bytes."""
    made = array("H" if width == "<u2" else "I", ids)
    if sys.byteorder != "little":
        made.byteswap()
    return made.tobytes()


class ChunkTable:
    """Maps chunk keys to values (never None); ``make`` computes the values of a list of new keys."""

    def __init__(self, make: Callable[[list[str]], list], most: int = MOST_CHUNKS):
        self.make, self.most, self.held = make, most, {}

    def values(self, runs: list[list[str]]) -> list[list]:
        """The values of several key sequences, in order."""
        get, out, gaps, new = self.held.get, [], [], {}
        for keys in runs:
            found = list(map(get, keys))
            gap = [i for i, v in enumerate(found) if v is None]
            new.update((keys[i], None) for i in gap)
            out.append(found)
            gaps.append(gap)
        if new:
            names = list(new)
            new = dict(zip(names, self.make(names)))
            room = self.most - len(self.held)
            if room > 0:
                self.held.update((k, new[k]) for k in names[:room] if len(k) <= LONGEST_KEPT)
            for keys, found, gap in zip(runs, out, gaps):
                for i in gap:
                    found[i] = new[keys[i]]
        return out


#: Value of a key that must not be cut out of its text.
NOT_ALONE = False


class PieceCodec:
    """SentencePiece ids and decoded text through a distinct-chunk table.

    Sound when no piece of the vocabulary holds a marker behind another character (checked on loading):
    merges then never cross from the end of a word to the marker of the next one.  Texts that hold the
    marker character itself go to the library whole.
    """

    MARK = "▁"
    _RUNS = re.compile(r" +[^ ]*")

    def __init__(self, path: str, most: int = MOST_CHUNKS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        self.cuttable = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and self.sp.encode("a  b", out_type=str)[0].startswith(self.MARK) and self.sp.normalize("ﬁ a") == f"{self.MARK}ﬁ{self.MARK}a"
        self.mark_id = self.sp.piece_to_id(self.MARK)
        self.table = ChunkTable(self._make, most)
        self.begin, self.end = pack([self.sp.bos_id()]), pack([self.sp.eos_id()])

    def _make(self, keys: list[str]) -> list[tuple[bytes, str]]:
        ids = [i if k else [self.mark_id] for k, i in zip(keys, self.sp.encode(keys, num_threads=1))]
        return [(pack(i), d) for i, d in zip(ids, self.sp.decode(ids, num_threads=1))]

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids with begin and end (little-endian uint32) and the text decoded from them."""
        out: list = [(self.begin + self.end, "")] * len(texts)
        runs, where = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuttable or self.MARK in text:
                ids = [self.sp.bos_id(), *self.sp.encode(text), self.sp.eos_id()]
                out[i] = (pack(ids), self.sp.decode(ids))
                continue
            keys = text.split(" ")
            if "" in keys:
                keys = [c[1:] for c in self._RUNS.findall(" " + text)]
            runs.append(keys)
            where.append(i)
        for i, values in zip(where, self.table.values(runs)):
            ids, words = zip(*values)
            out[i] = (b"".join((self.begin, *ids, self.end)), " ".join(words))
        return out


class BytePairCodec:
    """Ids of a byte-level BPE ``tokenizers`` file through a distinct-chunk table.

    Its pre-tokenizer never joins a character that is not white space to the space behind it, so texts are
    cut at single spaces.  Texts with white space next to a space, or with a special token's string, go
    to the library whole, as do all texts if the file has a normalizer or another kind of pre-tokenizer.
    """

    def __init__(self, path: str, most: int = 2 * MOST_CHUNKS):
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kind = told.get("pre_tokenizer") or {}
        self.cuttable = not told.get("normalizer") and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.special = [t["content"] for t in told.get("added_tokens", [])]
        self.width = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        names = map(self.lib.id_to_token, range(self.lib.get_vocab_size()))
        self.spaced = np.array([bool(n) and n.startswith("Ġ") for n in names])
        self.inner = ChunkTable(self._make, most)
        self.first = ChunkTable(self._first, most // 8)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [pack(e.ids, self.width) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(key: str) -> bool:
        return bool(key) and not key[0].isspace() and not key[-1].isspace()

    def _first(self, keys: list[str]) -> list[bytes | bool]:
        ids = self._ids(keys)
        return [i if self._plain(k) else NOT_ALONE for k, i in zip(keys, ids)]

    def _make(self, keys: list[str]) -> list[bytes | bool]:
        good = [k for k in keys if self._plain(k)]
        made = dict(zip(good, self._joined(good)))
        return [made.get(k, NOT_ALONE) for k in keys]

    def _joined(self, keys: list[str]) -> list[bytes]:
        """Ids of keys behind a space each: one call for all, cut where a token begins with the space."""
        ids = np.array(self.lib.encode_batch_fast(["".join([" " + k for k in keys])], add_special_tokens=False)[0].ids if keys else [], dtype=self.width)
        at = np.flatnonzero(self.spaced[ids]).tolist() if len(ids) else []
        if len(at) != len(keys):
            return self._ids([" " + k for k in keys])
        raw, w = ids.tobytes(), int(self.width[-1])
        return [raw[a * w : b * w] for a, b in zip(at, [*at[1:], len(ids)])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width``; null is empty."""
        out: list = [b""] * len(texts)
        heads, tails, where, whole = [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuttable or any(s in text for s in self.special):
                whole.append(i)
                continue
            keys = text.split(" ")
            heads.append(keys[:1])
            tails.append(keys[1:])
            where.append(i)
        for i, head, tail in zip(where, self.first.values(heads), self.inner.values(tails)):
            if head[0] is NOT_ALONE or NOT_ALONE in tail:
                whole.append(i)
            else:
                out[i] = b"".join((*head, *tail))
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]) if whole else ()):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


@lru_cache(maxsize=4)
def byte_pair_codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)
