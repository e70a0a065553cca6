"""Token ids by a public tokenizer, a piece at a time.

Both vocabularies split a text before any merge, at least at each edge between white space and other characters and
after each plain word that ends at white space or ASCII punctuation. Strings of special tokens are cut out first. So texts are cut at such edges and the ids of a
piece are kept: the library encodes each different piece once for every worker process.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from itertools import islice

from . import shared

#: The Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters that stay one letter in lower case: without the dotted capital I (U+0130).
LATIN = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ"
#: ASCII punctuation but for the apostrophe, which can start a contraction, and the underscore.
EDGE = r"!-&(-/:-@\[-\^`{-~"
WORD = rf"[{LATIN}]++(?=[{SPACE}{EDGE}]|\Z)"
#: Byte-level pieces keep one space before them; runs of white space keep their last character for what follows.
BYTE_LEVEL = re.compile(rf" ?{WORD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: The lower-casing vocabulary drops white space.
WORD_LEVEL = re.compile(rf"{WORD}|[^{SPACE}]+")
#: Pieces whose ids a worker keeps; when it has more, it drops the newer half, in which rare ones are. Speed only.
KEEP = 800_000


PLAIN = re.compile(rf" ?[{LATIN}]+")

#: Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_others = [b for b in range(256) if b not in _printable]
_character = {b: b for b in _printable} | {b: 256 + k for k, b in enumerate(_others)}
BYTE_CHARACTERS = "".join(chr(_character[b]) for b in range(256))


def in_byte_characters(word: str) -> str:
    return codecs.charmap_decode(word.encode(), "strict", BYTE_CHARACTERS)[0]


class Pieces(dict):
    """ids of pieces as little-endian unsigned 32-bit integers.

    A plain word goes to the model at once, written in byte characters: normalisers and splitting leave it as it is,
    but for its case where the vocabulary is lower-case. Everything else takes the library's whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: strings that the library takes for one id wherever they stand
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.model, self.lower = self.tokenizer.model, self.tokenizer.normalizer is not None

    def __missing__(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            found = [t.id for t in self.model.tokenize(in_byte_characters(piece.lower() if self.lower else piece))]
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
        ids = self[piece] = array("I", found).tobytes()
        return ids

    def shorten(self, least: int) -> None:
        """Leaves the pieces that came first, among which the frequent ones are."""
        first = list(islice(self.items(), least))
        self.clear()
        self.update(first)


def encoder(path: str, pattern: re.Pattern):
    """A function from text to the bytes of its ids; kept by the worker process across tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    coder = shared.kept(f"pieces of {path}", lambda: Pieces(path))
    find, get, special = pattern.findall, coder.__getitem__, coder.special

    def encode(text: str) -> bytes:
        if len(coder) > KEEP:
            coder.shorten(KEEP // 2)
        if special is not None and special.search(text):  # what lies between them is split by itself
            parts = special.split(text)
            return b"".join(get(x) if k % 2 else b"".join(map(get, find(x))) for k, x in enumerate(parts))
        return b"".join(map(get, find(text)))

    return encode


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
