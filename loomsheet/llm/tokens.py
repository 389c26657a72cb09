"""Token ids of whole texts by a tokenizer of the tokenizers library, piece by piece.

A byte-level vocabulary with the usual pattern never lets a token reach over a single space or line
end between two other characters, nor from a letter or digit to the stops that end a word. Texts are
cut there by Arrow's text functions; the pieces that a task has seen before are looked up in an Arrow
array, and only new ones are given to the library. Texts with runs of white space, and those of other
tokenizers, are given to it whole. The ids are those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x1f"
ODD = r"[\s\x0b\x{85}\p{Z}]{2}|\x1f"
STOPS = rf"([\p{{L}}\p{{N}}])([.,;:!?]+)({MARK}|$)"
KEPT = 600_000  # pieces that a task remembers
LONGEST = 40  # code points of a piece that is worth remembering


class Encoder:
    """Encodes columns of texts; one for each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.own.get_vocab_size(with_added_tokens=True) <= 2**16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        self.by_piece = made.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.used = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> pa.Array:
        return pa.array(self.whole(new.to_pylist()), pa.large_binary())

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, one after the other in ``kind``; texts without nulls."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(np.flatnonzero(odd), self.whole(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            out[k] = ids
        for k, ids in zip(np.flatnonzero(~odd), self._pieces(texts.filter(pa.array(~odd))), strict=True):
            out[k] = ids
        return out

    def _pieces(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{MARK} "), "\n", f"{MARK}\n{MARK}")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, STOPS, rf"\1{MARK}\2\3"), MARK)
        words = lists.flatten()
        at = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(at)
        new = pc.unique(words.filter(missing))
        words_all, ids_all = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self._learn(new)])
        later = pc.add(pc.index_in(words.filter(missing), value_set=new), len(self.words))
        at = pc.replace_with_mask(at, missing, later.cast(at.type))
        flat = ids_all.take(at)
        _, offsets, data = flat.buffers()
        ends = np.frombuffer(offsets, np.int64, len(flat) + 1, flat.offset * 8)[lists.offsets.to_numpy()]
        raw = memoryview(data) if data is not None else memoryview(b"")
        out = [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        self._keep(words_all, ids_all, np.bincount(at.to_numpy(), minlength=len(words_all)))
        return out

    def _keep(self, words: pa.Array, ids: pa.Array, seen: np.ndarray) -> None:
        """Remembers short pieces; when there are too many, those that were used most."""
        used = seen + np.pad(self.used, (0, len(words) - len(self.used)))
        keep = pc.less_equal(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        if keep.sum() > KEPT:
            keep &= used > np.partition(used[keep], -(KEPT // 2))[-(KEPT // 2)]
        if not keep.all():
            words, ids, used = words.filter(pa.array(keep)), ids.filter(pa.array(keep)), used[keep]
        self.words, self.ids, self.used = words, ids, used


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
