"""Token ids of whole texts by the tokenizers library, with each task's own store of pieces.

Both vocabularies split a text into pre-tokens that never cross certain white space, so a
text is cut there, distinct pieces are encoded once and their ids are joined. The cuts are
those for which the result equals the whole text's encoding (tests compare them); texts for
which that isn't certain are encoded whole. The store is bounded and drops all when full.
The vocabulary without white space lower-cases, so a text of plain characters is cut right
into its lower-case pre-tokens, of which there are far fewer than pieces.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STORE = 60_000
_MARKS = frozenset(",.;:!?)")
#: Any white space but a space or newline; texts with it are encoded whole.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")

#: What the cuts of spaced texts, a space put before each newline, can't bear: such white space, and white space that meets white space or an end.
_UNCUT = "\\A |  |\n | \\z|\n\\z|\\x00|" + _OTHER_SPACE.pattern
_FIRST = "\0"  # before a text's first piece, which has no space

#: Pieces of which both vocabularies make the letters one pre-token and the punctuation another;
#: the letters are those that normalization leaves alone but for their case.
_LETTERS, _MARKED = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "[!-&(-/:-@\\[-`{-~]"
_PLAIN = re.compile(f"({_LETTERS}*)({_MARKED}*)")
_PLAIN_PIECE = f"\\A(?P<word>\n?{_LETTERS}+)(?P<marks>{_MARKED}*)\\z"

#: Texts that normalization leaves alone but for case and white space, and the pre-tokens of their lower-case form.
_PLAIN_TEXT = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PRE_TOKENS = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
LONG = 64  # characters; longer pre-tokens aren't kept


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def loaded(path: str):
    """(tokenizer, each id as bytes); a Python worker keeps them for its next task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class _Parts(dict):
    """Pre-token -> its ids, made by the vocabulary's merges when first asked for."""

    def __init__(self, tokenizer, ids: list):
        self.tokenize, self.ids = tokenizer.model.tokenize, ids

    def __missing__(self, part: str) -> bytes:
        ids = self.ids
        out = self[part] = b"".join([ids[t.id] for t in self.tokenize(part)])
        return out


class _Words(dict):
    """Lower-case word between white space -> its ids; pre-tokens are kept, made by the vocabulary's merges when first asked for."""

    def __init__(self, tokenizer, ids: list, letters: list[str]):
        self.tokenize, self.ids = tokenizer.model.tokenize, ids
        self.letters = dict(enumerate(letters))

    def __missing__(self, word: str) -> bytes:
        if not word.isalpha():
            parts = _PRE_TOKENS(word)
            if len(parts) != 1:
                return b"".join(map(self.__getitem__, parts))
        ids = self.ids
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        out = b"".join([ids[t.id] for t in self.tokenize(shown)])
        if len(word) <= LONG:
            self[word] = out
        return out


class _Spaced(dict):
    """Letters that follow a space, or a newline that is given with them -> their ids, made by the vocabulary's merges when first asked for."""

    def __init__(self, tokenizer, ids: list, letters: list[str]):
        self.tokenize, self.ids = tokenizer.model.tokenize, ids
        self.letters, self.space, self.line = dict(enumerate(letters)), letters[32], tokenizer.token_to_id(letters[10])

    def __missing__(self, word: str) -> bytes:
        ids = self.ids
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        if word[0] == "\n":
            out = ids[self.line] + b"".join([ids[t.id] for t in self.tokenize(shown[1:])])
        else:
            out = b"".join([ids[t.id] for t in self.tokenize(self.space + shown)])
        if len(word) <= LONG:
            self[word] = out
        return out


class _Pieces(dict):
    """Piece of a vocabulary without white space -> its ids, made when first asked for."""

    def __init__(self, encoder):
        self.encoder, self.plain, self.parts = encoder, encoder._plain, encoder.parts
        self.tokenize, self.ids = encoder.parts.tokenize, encoder.parts.ids

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():  # one pre-token
            ids = self.ids
            out = b"".join([ids[t.id] for t in self.tokenize(piece.lower())])
        elif piece[-1:] in _MARKS and piece[:-1].isascii() and piece[:-1].isalpha():  # two
            out = self[piece[:-1]] + self.parts[piece[-1]]
        else:
            out = self.plain(piece) if piece else b""
            if out is None:
                out = self.encoder._encode([piece])[0]
        self[piece] = out
        return out


class Encoder:
    """ids(texts) gives for each text (None: empty) its ids as little-endian unsigned 32-bit numbers.

    `spaced`: white space belongs to the tokens (byte-level vocabularies); else it is dropped.
    `keep`: pieces that the store may have before it drops all.
    """

    def __init__(self, path: str, spaced: bool, keep: int = STORE):
        self.tokenizer, ids = loaded(path)
        self.spaced, self.keep = spaced, keep
        self.letters = byte_letters()
        self.parts = _Parts(self.tokenizer, ids)
        self.store = _Pieces(self)
        self.words = (_Spaced if spaced else _Words)(self.tokenizer, ids, self.letters)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 512):
            out += [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts[i : i + 512], add_special_tokens=False)]
        return out

    def _plain(self, piece: str) -> bytes | None:
        """The ids of a plain piece straight from the vocabulary's merges; None if it isn't plain."""
        found = _PLAIN.fullmatch(piece)
        if not found:
            return None
        word, marks = found.groups()
        word, parts = word.lower(), self.parts
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return (parts[word] if word else b"") + (parts[marks] if marks else b"")

    def _spaced_texts(self, texts: list[str]) -> list[bytes | None]:
        """The ids of texts cut before white space; None: to be encoded whole."""
        if not texts:
            return []
        cut = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        fit = pc.invert(pc.match_substring_regex(cut, _UNCUT))
        first, none = pa.scalar(_FIRST, pa.large_string()), pa.scalar("", pa.large_string())
        found = iter(self._looked_up(pc.split_pattern(pc.binary_join_element_wise(first, cut.filter(fit), none), " "), self._spaced_pieces))
        return [next(found) if f else None for f in fit.to_pylist()]

    def _spaced_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces: of plain ones each word's, looked up once, and each mark's; others are encoded together."""
        found = pc.extract_regex(pieces, _PLAIN_PIECE)
        plain = found.is_valid()
        word, marks = found.filter(plain).flatten()
        made = pc.binary_join_element_wise(self._each(word, self.words), self._each(marks, self.parts), pa.scalar(b"", pa.large_binary()))
        store, odd = self.store, _strings(pieces.filter(pc.invert(plain)))
        new = [p for p in odd if p not in store]
        store.update(zip(new, self._encode([p[1:] if p[0] == _FIRST else p if p[0] == "\n" else " " + p for p in new])))
        made = pa.concat_arrays([made, pa.array(list(map(store.__getitem__, odd)), pa.large_binary())])
        # where the plain and the others stand
        plain = plain.to_numpy(zero_copy_only=False)
        return made.take(pa.array(np.where(plain, np.cumsum(plain) - 1, np.cumsum(~plain) - 1 + np.count_nonzero(plain))))

    @staticmethod
    def _each(words: pa.Array, store: dict) -> pa.Array:
        coded = words.dictionary_encode()
        return pa.array(list(map(store.__getitem__, _strings(coded.dictionary))), pa.large_binary()).take(coded.indices)

    def _plain_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts by the words of their lower-case form."""
        if not texts:
            return []
        return self._looked_up(pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string())), lambda words: self._each(words, self.words))

    @staticmethod
    def _looked_up(words: pa.ListArray, look: Callable[[pa.Array], pa.Array]) -> list[bytes]:
        """The joined ids of each list of words; `look` gives those of the distinct words, the rest is done on Arrow's buffers."""
        coded = words.flatten().dictionary_encode()
        made = look(coded.dictionary).take(coded.indices)
        _, offsets, data = made.buffers()
        at = np.frombuffer(offsets, "<i8", len(made) + 1, 8 * made.offset)[words.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def ids(self, texts: list) -> list[bytes]:
        out: list = [b""] * len(texts)
        split, whole, plain = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if "<|" in t:  # a special token's string may take part
                whole.append(i)
            elif not self.spaced and _PLAIN_TEXT.fullmatch(t):
                plain.append(i)
            else:
                split.append(i)
        for store in (self.words, self.store, self.parts):
            if len(store) > self.keep:
                store.clear()
        for i, v in zip(plain, self._plain_texts([texts[i] for i in plain])):
            out[i] = v
        if self.spaced:
            for i, v in zip(split, self._spaced_texts([texts[i] for i in split])):
                if v is None:
                    whole.append(i)
                else:
                    out[i] = v
        else:
            for i in split:
                out[i] = b"".join(map(self.store.__getitem__, texts[i].replace("\n", " ").split(" ")))
        for i, v in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = v
        return out
