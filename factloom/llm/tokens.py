"""Token ids of whole texts, word by word: each distinct word of a batch is encoded once.

This holds for tokenizers that treat ASCII white space as a separator and nothing more.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers (about 150 bytes each).
CACHE_WORDS = 200_000
#: The same for an encoder whose words are dear to encode, if its caller names no other number.
ENCODER_WORDS = 1_000_000


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Dictionary-encoded words of all texts in order, and the number of words of each text (null: none)."""
    if texts.offset:  # kernels on slices have given wrong bytes: copy
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = pc.list_flatten(lists)
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    owner = pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(words, "")  # white space at an end leaves an empty word
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    return words.dictionary_encode(), np.bincount(owner, minlength=len(texts))


def spread(parts_at: np.ndarray, parts_len: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Places, in the joined parts, of the items of parts index[0], index[1], ..."""
    n = parts_len[index]
    ends = np.cumsum(n)
    return np.repeat(parts_at[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Ids of texts by the `tokenizers` library, `add_special_tokens=False`, with a bounded cache of words."""

    SEPARATOR = "<|endoftext|>"
    #: A pre-tokenizer by which a letter and one of PUNCTUATION after it never share a token.
    PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"
    PUNCTUATION = r"([A-Za-z])([!-&(-/:-@\[-`{-~])"

    def __init__(self, path: str, words: int = ENCODER_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.cache: dict[str, bytes] = {}
        self.words = words
        normalizer = self.tokenizer.normalizer
        #: The tokenizer lower-cases by itself: words that differ in case alone are then encoded once.
        self.lowers = normalizer is not None and normalizer.normalize_str("AbC") == "abc"

        #: Punctuation after a letter is encoded apart: white space there changes no id, and fewer words differ.
        self.parted = self._is_parted()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a run of letters
        if self.parted and getattr(self.tokenizer.model, "end_of_word_suffix", None) == self.WORD_END:
            self.ends[[i for t, i in vocab.items() if t.endswith(self.WORD_END)]] = True

    def _is_parted(self) -> bool:
        spec = json.loads(self.tokenizer.to_str())
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        split = first == {"type": "Split", "pattern": {"Regex": self.PARTED}, "behavior": "Removed", "invert": True}
        kinds = {"NFC", "Lowercase", "Replace"}  # none joins or parts a letter and punctuation
        normalizers = (spec["normalizer"] or {}).get("normalizers") or []
        white = all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normalizers if n["type"] == "Replace")
        return split and white and {n["type"] for n in normalizers} <= kinds

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Many words go through the library as one sequence: those of letters alone are parted by
        a space and told apart by the ids that end a word; others are parted by a special token
        (which the library cuts out before anything else); words that hold its text go alone."""
        out: list[bytes] = [b""] * len(words)
        # letters alone make one or more runs each, so as many ends as words are one of each
        letters = [i for i, w in enumerate(words) if w.isalpha()] if self.ends.any() else []
        left = set(range(len(words))).difference(letters)
        for at in range(0, len(letters), 512):
            some = letters[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.nonzero(self.ends[ids])[0] + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                left.update(some)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            ends = (cuts * size).tolist()
            for i, s, e in zip(some, [0, *ends], ends, strict=False):
                out[i] = raw[s:e]
        plain = [i for i in sorted(left) if self.separator is not None and "<|" not in words[i]]
        alone = left.difference(plain)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.SEPARATOR.join(words[i] for i in some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.nonzero(ids == self.separator)[0]
            if len(cuts) != len(some) - 1:
                alone.update(some)
                continue
            for i, part in zip(some, np.split(ids, cuts), strict=True):
                out[i] = (part[1:] if len(part) and part[0] == self.separator else part).tobytes()
        alone = sorted(alone)
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        # special tokens are matched before case is dropped
        special = bool(pc.any(pc.match_substring(texts, "<|")).as_py())
        lower = self.lowers and not special
        if self.parted and not special:
            texts = pc.replace_substring_regex(texts.cast(pa.large_string()), self.PUNCTUATION, r"\1 \2")
        words, counts = split_words(texts, lower=lower)
        distinct = words.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self.cache]
        new = dict(zip(missing, self._encode_words(missing), strict=True))
        parts = [self.cache[w] if w in self.cache else new[w] for w in distinct]
        if len(self.cache) < self.words:
            self.cache.update(new)
        size = self.dtype.itemsize
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // size
        joined = np.frombuffer(b"".join(parts), self.dtype)
        index = words.indices.to_numpy()
        ids = joined[spread(np.cumsum(lengths) - lengths, lengths, index)]
        ends = np.concatenate([[0], np.cumsum(lengths[index])])
        at = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[at[1:]] - ends[at[:-1]]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, words: int = ENCODER_WORDS) -> WordEncoder:
    """One encoder a worker process, file and number of words remembered."""
    if (path, words) not in _encoders:
        _encoders[path, words] = WordEncoder(path, words)
    return _encoders[path, words]
