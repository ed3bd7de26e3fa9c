"""Encoding with the tokenizers library inside Arrow batches: one tokenizer and one bounded memo a worker."""

from __future__ import annotations

import functools
import os

from plateworks.llm import bpe

#: Texts that go to the library in one call.
CALL = 256


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, single-threaded (Spark's tasks are the threads), without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Words:
    """Token counts of what stands between spaces, as the library gives them.

    It holds for tokenizers that drop white space and never join what stands on both sides of it.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.counts: dict[str, int] = {"": 0}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.counts) > bpe.MEMO:
            self.counts = {"": 0}
        known, each = self.counts, [t.split(" ") for t in texts]
        new = list({w for words in each for w in words if w not in known})
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum([known[w] for w in words]) for words in each]


@functools.lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)
