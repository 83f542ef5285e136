"""Loading public tokenizer files, and cutting texts where no token can cross."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers

#: ASCII white space after a non-space character: the byte-level patterns never match across this point. (Python also takes 0x1C to 0x1F
#: for space, the patterns do not; so they stand on neither side of a cut.)
_SAFE = re.compile(r"(?<=\S)(?=[ \t-\r])")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


@lru_cache(4)
def special_strings(path: str) -> dict[str, int]:
    """Added tokens of a tokenizers file, which its default turns into one id each."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@lru_cache(4)
def library(path: str):
    """The tokenizers library's object for a .json file; one thread, neither truncation nor padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def rank_encoder(path: str):
    """tiktoken over the vocabulary of a tokenizers .json file of byte-level BPE; None where its ids do not follow its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters, special = spec["model"]["vocab"], byte_alphabet(), special_strings(path)
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    tokens = {t: i for t, i in vocab.items() if t not in special}
    if spec["model"].get("end_of_word_suffix") or made != sorted(set(made)) or not all(c in letters for t in tokens for c in t):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in tokens.items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(text: str, limit: int) -> Iterator[str]:
    """Consecutive parts of text of about `limit` characters, cut at ASCII white space that follows a non-space character.

    Encoding the parts and joining the ids equals encoding the text. A part without such a place stays whole.
    """
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text
