"""Public tokenizer files, loaded once per Python worker."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator


def resolve(vocab: str) -> str:
    """An absolute path as it is; any other name is a file of ``public_tokenizers``
    where the code runs (each executor has its own copy of that library)."""
    if os.path.isabs(vocab):
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


@functools.lru_cache(maxsize=4)
def load(vocab: str):
    """``tokenizers.Tokenizer`` of a .json file, without padding or truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(resolve(vocab))
    found.no_padding()
    found.no_truncation()
    return found


def bundles(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; every text in one run."""
    some: list[str] = []
    held = 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some
