"""Ids of whole texts from a tokenizer of which no token spans white space, found once for each different word.

The tokenizer drops white space, so a text's ids are those of its words one after another. Nor does a token span the end of a run of letters: a word of plain letters with
signs behind it is put together from the two. Splitting and telling words apart is Arrow's work, ids are gathered with numpy, and the library sees each new
run of letters, or other word, once for as long as it is remembered. Words that are not plain (other scripts, digits, special tokens) go to it as they are.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker remembers at most; beyond that it forgets them and begins anew.
REMEMBERED = 1_000_000

_PLAIN = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?]*)$"


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-cased plain letters need no normal form: the model alone does what the library would do
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.runs: dict[str, int] = {}
        self.others: dict[str, int] = {"": 0}
        self.size, self.pool = 0, np.zeros(1 << 16, np.uint32)
        self.count, self.start, self.length = 1, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, into: dict[str, int]) -> None:
        """Remember the ids of words, given one after another."""
        while self.size + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.pool[self.size : self.size + len(ids)] = ids
        self.start[self.count : self.count + len(words)] = self.size + np.cumsum(lengths) - lengths
        self.length[self.count : self.count + len(words)] = lengths
        into.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.size, self.count = self.size + len(ids), self.count + len(words)

    def _learn_runs(self, words: list[str]) -> None:
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            ids = np.array(self.letters.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == len(part):
                self._keep(part, ids, np.diff(ends, prepend=-1), self.runs)
            else:  # a vocabulary without ends of words
                self._one_by_one(self.letters, part, self.runs)

    def _one_by_one(self, tokenizer, words: list[str], into: dict[str, int]) -> None:
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            found = [x.ids for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64), into)

    def _numbers(self, words: pa.Array, known: dict[str, int], learn) -> np.ndarray:
        """The number of each of the words; new ones are learned."""
        told = words.dictionary_encode()
        different = told.dictionary.to_pylist()
        if not different:
            return np.zeros(0, np.int32)
        numbers = list(map(known.get, different))
        if None in numbers:
            learn([w for w, n in zip(different, numbers, strict=True) if n is None])
            numbers = list(map(known.__getitem__, different))
        return np.array(numbers, np.int32)[told.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one more than texts). Null is empty."""
        if self.count > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for sign in "\n\t\r":
            texts = pc.replace_substring(texts, sign, " ")
        split = pc.split_pattern(texts, " ")
        told = split.flatten().dictionary_encode()
        if not len(told):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        words = told.dictionary
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid()
        is_plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        some = parts.filter(plain)
        first[is_plain] = self._numbers(pc.utf8_lower(some.field("run")), self.runs, self._learn_runs)
        learn = lambda new: self._one_by_one(self.tokenizer, new, self.others)
        second[is_plain] = self._numbers(some.field("signs"), self.others, learn)
        first[~is_plain] = self._numbers(words.filter(pc.invert(plain)), self.others, learn)
        at = told.indices.to_numpy(zero_copy_only=False)
        both = np.empty(2 * len(at), np.int32)
        both[0::2], both[1::2] = first[at], second[at]
        lengths = self.length[both]
        ends = np.cumsum(lengths, dtype=np.int64)
        places = np.repeat(self.start[both] - (ends - lengths), lengths)
        places += np.arange(len(places))
        ids = self.pool[places]
        offsets = split.offsets.to_numpy().astype(np.int64)
        return ids, np.concatenate([[0], ends])[2 * (offsets - offsets[0])]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)
