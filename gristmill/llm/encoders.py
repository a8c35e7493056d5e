"""Worker-side encoders over the installed tokenizer libraries.

Each encoder turns pre-tokens (see ``segments``) into token ids.  One lives in each Python
worker and outlasts its tasks, so its caches do too.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

from gristmill.llm.segments import Splitter, WordCache


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + n) for n, b in enumerate(rest)}


class JsonEncoder:
    """Ids by the ``tokenizers`` library for a byte-level BPE ``.json`` file.

    Texts are split into pre-tokens here and the library's model merges each distinct one; what
    isn't in settled letters, and any text that holds a special string, goes through the library's
    whole pipeline.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.split = Splitter(pattern, raw=True, special=tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))

    def ids(self, word: str | tuple[str]) -> list[int]:
        """Ids of one of the splitter's pre-tokens or stretches."""
        if type(word) is tuple:
            return self.tokenizer.encode(word[0], add_special_tokens=False).ids
        return [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))]


@lru_cache(maxsize=2)
def json_encoder(path: str, pattern: str) -> JsonEncoder:
    return JsonEncoder(path, pattern)


@lru_cache(maxsize=2)
def json_id_cache(path: str, pattern: str) -> tuple[Splitter, WordCache, str]:
    """A splitter, its words' packed ids, to be joined, and their array type: 2 bytes an id where the vocabulary fits, else 4."""
    encoder = json_encoder(path, pattern)
    code = "H" if max(encoder.tokenizer.get_vocab().values()) < 1 << 16 else "I"
    return encoder.split, WordCache(lambda word: array(code, encoder.ids(word)).tobytes()), "<u2" if code == "H" else "<u4"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
