"""Exact tokenizer output, with the library asked once for each distinct word of a batch instead of each occurrence.

The pre-tokenizers used here end every token where a word meets the single space or newline after it, so the ids of a
text are those of its words, one after the other. Arrow splits a batch of texts into words and numbers the distinct
ones; a bounded cache, as old as the worker process, holds ids of words met before; numpy lays the ids out again.
Texts with runs of white space, other kinds of white space or special strings go to the library whole, and so do
all texts under a tokenizer of another layout.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident

CACHE_WORDS = 400_000
KEEP_WORDS = 250_000
LONG_WORD = 80
SLICE_BYTES = 2_000_000
ASK = 64
#: Two white spaces in a row, one at either end, or one that is neither space nor newline. Wide on purpose: it also has
#: characters that only some libraries call white space.
_WHOLE = r"[ \n][ \n]|^[ \n]|[ \n]\z|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LETTERS = re.compile(f"[{_LATIN}]+")
#: Plain punctuation between a letter and the end of a word is a token of its own.
_TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,!?;:|#$%&*]+)(\x00|\z)"
#: Byte-level vocabularies write each byte as a printable character: itself, or the next from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_SHOWN = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in set(_SHOWN))}


def place(name: str) -> str:
    """A vocabulary's path: as given, or from the installed package of public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(name: str) -> str:
    """SHA-256 of the vocabulary file: a new file is a new tokenizer version."""
    with open(place(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class IdEncoder:
    """Ids of texts as little-endian uint32, from a tokenizers file."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(place(name))
        spec = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [{}])[0]
        plain = not spec.get("truncation") and not spec.get("padding") and not spec.get("post_processor")
        #: A space belongs to the word after it; a newline stands alone.
        self.spaced = plain and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        #: Spaces are dropped.
        self.bare = plain and first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed"
        self.cache: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        """What the library gives, text by text."""
        out = []
        for k in range(0, len(texts), ASK):
            out += [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts[k : k + ASK], add_special_tokens=False)]
        return out

    def ask(self, words: list[str]) -> list[bytes]:
        """Ids of words. A word of Latin letters is one pre-token, so it can go to the library's model at once."""
        out: list[bytes] = []
        other = []
        for w in words:
            body = w[1:] if self.spaced and w[:1] == " " else w
            if _LETTERS.fullmatch(body):
                shown = (w if self.spaced else w.lower()).encode().decode("latin-1").translate(_AS_SHOWN)
                out.append(array.array("I", [t.id for t in self.tok.model.tokenize(shown)]).tobytes())
            else:
                other.append(w)
                out.append(b"?")
        rest = iter(self.library(other))
        return [next(rest) if v == b"?" else v for v in out]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the texts' borders in them. Null texts have no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        cuts, room = [0], SLICE_BYTES
        for k, n in enumerate(sizes):
            room -= n
            if room < 0:
                cuts.append(k + 1)
                room = SLICE_BYTES
        parts = [self._slice(texts.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True) if b > a]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "<u4")
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))]).astype(np.int64) if parts else np.zeros(1, np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and each text's number of ids."""
        whole = pc.match_substring_regex(texts, _WHOLE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False)
        if not (self.spaced or self.bare):
            whole[:] = True
        easy = np.flatnonzero(~whole)
        ids, lengths = self._words(texts.take(pa.array(easy))) if easy.size else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if easy.size == len(whole):
            return ids, lengths
        hard = np.flatnonzero(whole)
        found = self.library(texts.take(pa.array(hard)).to_pylist())
        out, borders = [np.zeros(0, "<u4")] * len(whole), np.concatenate([[0], np.cumsum(lengths)])
        for k, a, b in zip(easy, borders, borders[1:], strict=False):
            out[k] = ids[a:b]
        for k, v in zip(hard, found, strict=True):
            out[k] = np.frombuffer(v, "<u4")
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts of words with one space or newline between them."""
        if self.spaced:
            # A mark before each border keeps the space or newline with its word: both belong to what follows them.
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
        else:
            texts = pc.replace_substring(pc.replace_substring(texts, "\n", " "), " ", "\x00")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _TAIL, r"\1" + "\x00" + r"\2\3"), "\x00")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.cache.get, words))
        if None in found:
            at = [k for k, v in enumerate(found) if v is None]
            for k, v in zip(at, self.ask([words[k] for k in at]), strict=True):
                found[k] = v
            if len(self.cache) + len(at) > CACHE_WORDS:  # what came first is what comes often
                for w in list(self.cache)[KEEP_WORDS:]:
                    del self.cache[w]
            self.cache.update((words[k], found[k]) for k in at if len(words[k]) <= LONG_WORD)
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lengths = size[codes]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(start[codes] - ends + lengths, lengths) + np.arange(ends[-1] if ends.size else 0)]
        borders = lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()
        at = np.concatenate([[0], ends])[borders]
        return ids, np.diff(at)


def id_encoder(name: str) -> IdEncoder:
    """The worker process's encoder, with its cache."""
    return resident(("ids", name), lambda: IdEncoder(name))


def drops_spaces(name: str) -> bool:
    """Do runs of spaces, and spaces at the ends, not count? The library is asked; special strings with spaces rule it out."""
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=place(name))
        ids, special = sp.encode, [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if sp.is_control(k)]
    else:
        encoder = IdEncoder(name)
        ids, special = (lambda t: encoder.library([t])[0]), encoder.special
    return not any(" " in s for s in special) and ids("  a   b, c  \n  d ") == ids("a b, c \n d")


class Counter:
    """Token counts of texts as the vocabulary's own library gives them."""

    def __init__(self, name: str):
        self.name, self.sp = name, None
        if name.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=place(name))

    def count(self, texts: pa.Array) -> list[int]:
        if self.sp is None:
            return np.diff(id_encoder(self.name).encode(texts)[1]).tolist()
        return [len(self.sp.encode(t.as_py(), num_threads=1)) if t.is_valid else 0 for t in texts]


def counter(name: str) -> Counter:
    """The worker process's counter."""
    return resident(("counter", name), lambda: Counter(name)) if name.endswith(".model") else Counter(name)
