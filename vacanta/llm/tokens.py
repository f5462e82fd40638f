"""Token ids of whole texts, as little-endian unsigned 32-bit numbers."""

from __future__ import annotations

import os
import re
import string
from array import array

from vacanta.llm.common import per_worker

# White space of any kind that is not one of the six ASCII characters.
_ASCII_SPACE = " \t\n\r\x0b\x0c"
_CHUNK = re.compile(f"[^{_ASCII_SPACE}]+")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = string.punctuation.replace("'", "")
# Letters that one code point and one lower-case letter stand for, whatever normal form is asked for.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Byte-level models write a byte that is no printable character of Latin-1 as one beyond U+00FF, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
# Entries kept by a worker: chunks as they stand, plain words, trailing punctuation. About 70 MB in all.
_KEPT_CHUNKS, _KEPT_CORES, _KEPT_TAILS = 120_000, 200_000, 20_000


class WordIds(dict):
    """Ids of white-space separated chunks, each tokenized once by a worker as long as there is room for it.

    The tokenizer never joins chunks, so a text's ids are the ids of its chunks in order. A word of Latin letters with
    trailing ASCII punctuation is two pieces to the tokenizer's own splitter, and the model is asked for each.
    """

    def __init__(self, tokenizer, space: str, mark: str, fold: bool):
        self.tokenizer, self.space, self.mark, self.fold = tokenizer, space, mark, fold
        self.model, self.cores, self.tails = tokenizer.model, {}, {}

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(_TAIL)
        if _LETTERS.fullmatch(core):
            ids = self._core(core.lower() if self.fold else core)
            if len(core) < len(chunk):
                ids += self._tail(chunk[len(core):])
        else:
            ids = self._whole(self.space + chunk)
        if len(self) < _KEPT_CHUNKS:
            self[chunk] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, core: str) -> bytes:
        ids = self.cores.get(core)
        if ids is None:
            written = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTES)
            ids = array("I", [t.id for t in self.model.tokenize(self.mark + written)]).tobytes()
            if len(self.cores) < _KEPT_CORES:
                self.cores[core] = ids
        return ids

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._whole(tail)
            if len(self.tails) < _KEPT_TAILS:
                self.tails[tail] = ids
        return ids


class WordTokenizer:
    """For tokenizers that drop white space and fold case, such as word_bpe_49k."""

    def __init__(self, path: str):
        tokenizer = load(path)
        self.ids = WordIds(tokenizer, "", "", True)

    def encode(self, text: str) -> bytes:
        chunks = text.split()
        spaces = sum(map(text.count, _ASCII_SPACE))
        if len(text) - sum(map(len, chunks)) != spaces:  # other white space, which is the tokenizer's to judge
            chunks = _CHUNK.findall(text)
        return b"".join(map(self.ids.__getitem__, chunks))


class ByteTokenizer:
    """For byte-level tokenizers that put a space before the word it precedes, such as byte_bpe_50k."""

    def __init__(self, path: str):
        tokenizer = load(path)
        self.first = WordIds(tokenizer, "", "", False)
        self.later = WordIds(tokenizer, " ", "Ġ", False)
        self.newline = self.first._whole("\n")

    def encode(self, text: str) -> bytes:
        chunks = text.split()
        gaps = len(chunks) - 1
        # Only single blanks and single line ends between words: every gap is then a known cut.
        if len(text) - sum(map(len, chunks)) == gaps == text.count(" ") + text.count("\n"):
            out = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                out += self.newline, self.first[head]
                out.extend(map(self.later.__getitem__, rest))
            return b"".join(out[1:])
        head, *rest = _SAFE_CUT.split(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, rest)) if text else b""


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def worker_tokenizer(kind: str, path: str):
    """The tokenizer of this worker, loaded once; kind is `word` or `byte`."""
    made = per_worker("tokenizers", dict)
    if (kind, path) not in made:
        made[kind, path] = {"word": WordTokenizer, "byte": ByteTokenizer}[kind](path)
    return made[kind, path]


def forget_tokenizers() -> None:
    """Give back what this worker's tokenizers hold, for work that needs none."""
    per_worker("tokenizers", dict).clear()
