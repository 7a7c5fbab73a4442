"""Tokenizers by name or path, and cached ids of text pieces on the executors.

A text is cut before each single space, and before each run of line feeds, that
follows a character other than white space.  Neither tokenizer kind here has a
token or pre-token across such a place (a pre-token holds white space only at
its front, or is white space alone), so ids of the pieces, joined, are the ids
of the text.  Texts whose words come again and again then cost a look-up a word.
A tokenizer with a normalizer (word_bpe) drops white space, so its texts are cut
at all of it, and lower-cased first where the normalizer would do no more.  New
words go to the library's model many in one text, and are told apart by the
tokens that only begin or only end a word.
"""

from __future__ import annotations

import os
import re

import numpy as np

from shelfspark.llm.common import CACHES

CACHE_ENTRIES = 400_000  # in each of two generations
LONG_PIECE = 4096
_SIGNS = ".,;:!?$%&*#()[]{}\"+-/="  # a run of them after letters is one pre-token; no apostrophe, and nothing of added tokens
_WHITE_AND_SPACE = re.compile(r"\s | \s")
_LINE_END = re.compile(r"(?<=\S)\n")
_RARE_WHITE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"  # of Latin-1
_NO_WHITE = "\x1c\x1d\x1e\x1f"  # white space for Python, and not for the tokenizers


def _cuttable(text: str) -> bool:
    """Whether each of the text's spaces has no other white space beside it."""
    if "  " in text or "\n " in text or " \n" in text:
        return False
    return _plain_white(text) or not _WHITE_AND_SPACE.search(text)


def _plain_white(text: str) -> bool:
    """Whether all white space is spaces and line feeds, as far as that is seen at once."""
    return _latin(text) and not any(c in text for c in _RARE_WHITE)


def _pieces_of(text: str) -> list[str]:
    """The text cut at spaces and before line ends; a piece of its own that has no space before it begins with a line feed."""
    return (text.replace("\n", " \n") if "\n\n" not in text and _plain_white(text) else _LINE_END.sub(" \n", text)).split(" ")


def _latin(text: str) -> bool:
    """Whether all characters are of Latin-1: each is in NFC, and is lower-cased by itself."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_open: dict[str, object] = {}
CACHES["tokenizers"] = _open.clear


def tokenizer_path(name: str) -> str:
    """name: a file, or the name of one of the public tokenizers installed."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer, one for each Python worker."""
    if name not in _open:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _open[name] = Tokenizer.from_file(tokenizer_path(name))
    return _open[name]


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: printable ones stand for themselves, the others follow 255 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class PieceIds:
    """Ids of texts as little-endian unsigned integers of the given width."""

    def __init__(self, name: str, dtype=np.uint32):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.dtype = load(name), np.dtype(dtype).newbyteorder("<")
        self.new: dict[str, bytes] = {}  # a piece without the space before it; one with a line feed first has none
        self.old: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.spaced = self.tokenizer.normalizer is None  # a pre-token holds the space before it
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Tokenizer(self.model)  # takes pre-tokens as the model gets them, with a space between
        self.words.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.marks = np.zeros(max(vocab.values()) + 1, dtype=bool)  # of such tokens each pre-token of letters has one: its first or its last
        suffix = self.model.end_of_word_suffix
        if self.spaced or suffix:
            self.marks[[i for t, i in vocab.items() if (t.startswith(self.letters[32]) if self.spaced else t.endswith(suffix))]] = True

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens of letters, as the model gets them, many in one text for the library."""
        out: list[bytes] = []
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            joined = [" ".join(some[j : j + 256]) for j in range(0, len(some), 256)]
            ids = np.array([x for e in self.words.encode_batch_fast(joined, add_special_tokens=False) for x in e.ids], dtype=self.dtype)
            at = np.flatnonzero(self.marks[ids])
            if len(at) != len(some):  # this vocabulary does not mark its words
                out += [np.array([t.id for t in self.model.tokenize(w)], dtype=self.dtype).tobytes() for w in some]
                continue
            bounds = (np.append(at, len(ids)) if self.spaced else np.append(0, at + 1)) * self.dtype.itemsize
            data, bounds = ids.tobytes(), bounds.tolist()
            out += [data[x:y] for x, y in zip(bounds, bounds[1:])]
        return out

    def _pre_token(self, word: str) -> str | None:
        """What the model gets of a space and a run of letters; None if the normalizer leaves more than letters."""
        plain = word.isascii()  # such letters stand for themselves
        if self.spaced:
            return self.letters[32] + (word if plain else word.encode().decode("latin-1").translate(self.letters))
        if plain:
            return word.lower()
        word = word.lower() if _latin(word) else self.tokenizer.normalizer.normalize_str(word)
        return word.encode().decode("latin-1").translate(self.letters) if word.isalpha() else None

    def _after_line_end(self, word: str) -> bytes:
        """Ids of letters that no space is before."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(text)], dtype=self.dtype).tobytes()

    def _letters_and_signs(self, pieces: set[str]) -> dict[str, bytes]:
        """Those pieces that are letters and then signs, two pre-tokens at most, and their letters alone; before them a line feed may stand."""
        words = {p for p in pieces if p.isalpha()}
        signed = {p: w for p in pieces - words if (w := p.rstrip(_SIGNS)).isalpha() or (w[:1] == "\n" and w[1:].isalpha())}
        words.update(signed.values())
        out = {w: self.new[w] for w in words & self.new.keys()}
        words.difference_update(out)
        lines = [w for w in words if w[0] == "\n"]
        if lines:  # the line feed is a pre-token of its own
            feed = self._encode(["\n"])[0]
            out.update((w, feed + self._after_line_end(w[1:])) for w in lines)
            words.difference_update(lines)
        given = {w: t for w in words if (t := self._pre_token(w)) is not None}
        texts = list(set(given.values()))
        ids = dict(zip(texts, self._words(texts)))
        out.update(zip(given, map(ids.__getitem__, given.values())))
        tails = {p[len(w) :] for p, w in signed.items()}
        ends = dict(zip(tails, self._encode(list(tails))))
        out.update({p: out[w] + ends[p[len(w) :]] for p, w in signed.items() if w in out})
        return out

    def _learn(self, need: set[str]) -> None:
        if len(self.new) > CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        missing = need.difference(self.new)
        for p in missing & self.old.keys():
            self.new[p] = self.old[p]
            missing.discard(p)
        words = self._letters_and_signs(missing)
        self.new.update(words)
        rest = list(missing.difference(words))
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            self.new.update(zip(some, self._encode([p if p[:1] == "\n" else " " + p for p in some])))

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where it has to go to the library as a whole."""
        if self.spaced:
            return _pieces_of(text) if _cuttable(text) else None
        if any(c in text for c in _NO_WHITE):
            return None
        if _latin(text):  # which the normalizer lower-cases and no more
            low = text.lower()
            if not any(t in low for t in self.added):
                return low.split()
        return text.split()  # no pre-token holds white space

    def of(self, texts: list[str | None]) -> list[bytes]:
        cut: list[tuple[str, list[str]]] = []
        need: set[str] = set()
        for t in texts:
            parts = self._cut(t) if t else []
            if parts is None or (len(t or "") > LONG_PIECE and max(map(len, parts), default=0) > LONG_PIECE):
                cut.append((t, []))
                continue
            head = parts.pop(0) if self.spaced and parts else ""  # the first piece of a text has no space before it
            cut.append((head, parts))
            need.update(parts)
        self._learn(need)
        get = self.new.__getitem__
        heads = iter(self._encode([h for h, _ in cut if h]))
        return [(next(heads) if h else b"") + b"".join(map(get, p)) for h, p in cut]


_pieces: dict[tuple, PieceIds] = {}
CACHES["pieces"] = _pieces.clear


def piece_ids(name: str, dtype=np.uint32) -> PieceIds:
    key = (name, np.dtype(dtype).str)
    if key not in _pieces:
        _pieces[key] = PieceIds(name, dtype)
    return _pieces[key]
