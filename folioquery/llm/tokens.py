"""Token ids of many texts at once, from the ids of their distinct runs between white space.

The word tokenizer drops white space and never joins characters across it, so the ids of a
text are those of its runs one after another. A slice of texts is split and its distinct runs
are numbered by Arrow; only those reach Python, and only words a worker has not met yet
reach the tokenizer, all of a slice in one call. Nothing depends on how the texts are sliced.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that are split at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Words whose ids a worker keeps between slices, and strings it encodes in one call.
CACHE_ENTRIES = 300_000
ENCODE_STRINGS = 2_000
#: A word of Latin letters, whose lower case has as many, and signs after it. The tokenizer lower-cases and parts letters
#: from signs, so such a run has the ids of the lower-case word and those of its signs. No sign here is an apostrophe.
WORD_AND_SIGNS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive slices of about ``size`` bytes; nulls are empty texts."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield at, texts.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the elements of slices (start, length), slice after slice."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class IdCache(dict):
    """Ids of strings as unsigned 32-bit integers in bytes; what is missing is encoded some thousands at a time."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def of(self, strings: list[str]) -> list[bytes]:
        if len(self) > self.entries:
            self.clear()
        new = [s for s in strings if s not in self]
        for at in range(0, len(new), ENCODE_STRINGS):
            part = new[at : at + ENCODE_STRINGS]
            for s, ids in zip(part, self.encode(part), strict=True):
                self[s] = array("I", ids).tobytes()
        return list(map(self.__getitem__, strings))


class Pool:
    """Ids of numbered strings, one after another."""

    def __init__(self, cache: IdCache, strings: pa.Array):
        ids = cache.of(strings.to_pylist())
        self.sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.frombuffer(b"".join(ids), np.uint32)


def numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The numbers of strings among the distinct ones, and those."""
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class WordIds:
    """Ids of texts by the word tokenizer of a file, special strings inside them as the library handles them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core to a task
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        # lower-case words of Latin letters need neither its normalizer nor its splitting
        merges = Tokenizer(whole.model)
        merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def ids(tokenizer: Tokenizer) -> Callable[[list[str]], list[list[int]]]:
            return lambda strings: [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

        self.words, self.others = IdCache(ids(merges)), IdCache(ids(whole))

    def split(self, texts: pa.Array) -> tuple[np.ndarray, Pool, np.ndarray, Pool, np.ndarray]:
        """For the runs of all texts the numbers of their word and of the rest, with the ids of both, and where each
        text's runs begin. A run that is no word and signs is rest alone."""
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        numbers, runs = numbered(lists.flatten())
        parts = pc.extract_regex(runs, pattern=WORD_AND_SIGNS)
        word, words = numbered(pc.utf8_lower(pc.fill_null(pc.struct_field(parts, "word"), "")))
        rest, others = numbered(pc.if_else(parts.is_valid(), pc.struct_field(parts, "signs"), runs))
        return word[numbers], Pool(self.words, words), rest[numbers], Pool(self.others, others), offsets - offsets[0]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        word, words, rest, others, offsets = self.split(texts)
        before = np.r_[0, np.cumsum(words.sizes[word] + others.sizes[rest])]
        return np.diff(before[offsets])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the borders of the texts."""
        word, words, rest, others, offsets = self.split(texts)
        both = np.r_[words.ids, others.ids]
        starts = np.stack([words.starts[word], len(words.ids) + others.starts[rest]], axis=1).ravel()
        sizes = np.stack([words.sizes[word], others.sizes[rest]], axis=1).ravel()
        before = np.r_[0, np.cumsum(sizes)]
        return both[gathered(starts, sizes)], before[2 * offsets]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The tokenizer of a worker, with what it has learnt."""
    return WordIds(path)
