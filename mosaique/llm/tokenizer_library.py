"""Token ids as the public tokenizer libraries give them (shared by operators 3 and 9)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache
from importlib.metadata import version

import numpy as np
import regex

from .pretokens import MemoEncoder, spliced

#: Fixed value: the pattern by which a ByteLevel pre-tokenizer with use_regex cuts a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the least lead byte of characters from U+0500 on, where the libraries' Unicode tables may differ
#: from regex's.
_FAR = 0xD4


class Library:
    """Ids of texts as little-endian unsigned 32-bit integers, without begin, end or added special tokens,
    truncation or padding; special strings inside texts are handled as is the library's default.

    A byte-level BPE file without normalizer is applied to distinct pre-tokens, which have the same ids alone
    as in their text. Texts that hold a special string, or characters of scripts for which the pattern is not
    sure to cut alike, go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.vocab_size, self.memo = 0, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab_size = model.vocab_size()
            self._plain = lambda texts: [array("I", x).tobytes() for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or made.get("normalizer") or made["model"].get("type") != "BPE" or made["model"].get("dropout"):
            self._plain = self._whole
            return
        special = [x["content"] for x in made.get("added_tokens", [])]
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in special)) if special else None
        self.memo = MemoEncoder(regex.compile(BYTE_LEVEL_PATTERN).findall, self._whole, self.vocab_size)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def view(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as bytes one after the other and n + 1 offsets: all ids, and n + 1 offsets of ids."""
        if self.memo is None:
            raw = data.tobytes()
            made = self._plain([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.frombuffer(b"".join(made), dtype="<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int64)
        far = np.flatnonzero(data >= _FAR)
        named = [m.start() for m in self.special.finditer(data)] if self.special else []
        hard = np.unique(np.searchsorted(offsets, np.concatenate([far, np.array(named, dtype=np.int64)]), side="right") - 1)
        if not len(hard):
            return self.memo.encode_view(data, offsets)
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in hard.tolist()]
        made = [np.frombuffer(x, dtype="<u4") for x in self._whole(texts)]
        lengths = np.diff(offsets)
        away = np.zeros(len(lengths), dtype=bool)
        away[hard] = True
        rest = data[np.repeat(~away, lengths)]
        lengths[away] = 0
        return spliced(*self.memo.encode_view(rest, np.concatenate([[0], np.cumsum(lengths)])), hard.tolist(), made)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        raw = [text.encode() for text in texts]
        ids, ends = self.view(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Library:
        return Library(path)


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file and its library's version: counts by another are never taken."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + f"{library} {version(library)}".encode()).hexdigest()
