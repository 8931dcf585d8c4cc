"""Token ids of whole texts by a tokenizer file of the tokenizers library, with a cache of words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

#: The tokenizer in production; a parameter of every operator that encodes.
WORD_BPE = "word_bpe_49k.json"
#: Words that a worker remembers; beyond that it starts anew.
CACHED_WORDS = 250_000
#: Longer words are not remembered.
LONG_WORD = 64
#: Punctuation between a letter and white space is a piece of its own for the tokenizer.
STOP = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\\[-`{-~]+)(?=[\\x20\\x09-\\x0D]|\\Z)")
#: What str.split takes for white space and the tokenizer doesn't.
ODD = re.compile("[\\x1c-\\x1f]")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
#: A word of these letters is one piece, which no normalizer changes.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: A text with this may hold a special token, which must be found as it stands.
SPECIAL = "<|"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_words(text: str) -> list[str]:
    """Parts of a text whose ids in turn are the text's."""
    if SPECIAL in text:
        return SPLIT.findall(text)
    try:
        text.encode("latin-1")
        text = text.lower()  # as the tokenizer does; one letter for one in this range
    except UnicodeEncodeError:
        pass
    text = STOP.sub(r" \1", text)
    return SPLIT.findall(text) if ODD.search(text) else text.split()


class WordEncoder:
    """Encodes text word by word, each distinct word once.

    Right for tokenizers that lower-case, drop white space and let no piece span it or join letters with punctuation that ends a
    word, as the default one does: the ids of a text are then those of its parts in turn. `check` compares both ways.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        letters = {b: x for x, b in byte_letters().items()}
        self.spelt = {x: "".join(letters[b] for b in chr(x).encode()) for x in range(0xDF, 0x100)}  # as the model is given them

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each path and worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str], batch_chars: int = 1_000_000) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= batch_chars):
                chars += len(texts[end])
                end += 1
            yield from self._encode(texts[start:end])
            start = end

    def _encode(self, texts: list[str]) -> Iterable[bytes]:
        words = [split_words(x) for x in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new, plain, tokenize = list(set().union(*words).difference(self.cache)), LETTERS.fullmatch, self.model.tokenize
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            rest = []
            for word in part:
                if plain(word):
                    self.cache[word] = array("I", [x.id for x in tokenize(word if word.isascii() else word.translate(self.spelt))]).tobytes()
                else:
                    rest.append(word)
            for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.cache[word] = array("I", e.ids).tobytes()
        out = [b"".join(map(self.cache.__getitem__, x)) for x in words]
        for word in new:
            if len(word) > LONG_WORD:
                del self.cache[word]
        return out

    def check(self, texts: list[str]) -> bool:
        whole = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return list(self.encode(texts)) == whole
