"""Byte-level BPE by whole pre-tokens.

The pre-token pattern splits a text so that no merge crosses a split; a pre-token's ids depend on it alone. Most
pre-tokens are vocabulary strings. `prove_whole_tokens` establishes, by encoding every vocabulary string once with the
library, which of them encode alone to exactly one token; those are looked up, and the merges run only for the rest.

The pattern and the library's own splitter follow different Unicode versions. `odd_code_points` finds where they
differ; inside the ranges of `_COVERED` they agree everywhere (a test goes through all of them), and a text with any
code point outside of those goes to the library as a whole.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array
from itertools import islice

import regex

from .common import BYTE_BPE, tokenizer_path

#: Entries of merged pre-tokens a worker keeps, half of them young; results stay the same.
MEMORY = 1 << 18
#: What the pattern says, for the standard library's faster engine. For Latin-1 without `_UNLIKE` both find the same: of
#: digits `\d` lacks only the numbers that are none (superscripts, fractions), of spaces `\s` adds the separators.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNLIKE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]")
#: Ranges in which both splitters agree on every code point.
_COVERED = "\u0000-\u0557\u0590-\u088e\u0900-\u0c5b\u2000-\u208e\u20a0-\ua7cd"


@functools.cache
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def pattern():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def specials(path: str) -> dict[str, int]:
    """Special strings; the library's default turns them into their ids wherever they occur in a text."""
    return {t.content: i for i, t in load_tokenizer(path).get_added_tokens_decoder().items()}


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The printable letters a byte-level vocabulary uses for bytes: printable Latin-1 stands for itself, the others
    are numbered from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def shortcut_applies(path: str) -> bool:
    """Whether a tokenizer file splits by this module's pattern into pre-tokens of bytes, without changing the text."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(load_tokenizer(path).to_str())
    split = spec["pre_tokenizer"] or {}
    same = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    return bool(same and spec["normalizer"] is None and not spec["model"].get("continuing_subword_prefix"))


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and that the library encodes to one token: string to id. Empty for a
    tokenizer to which the shortcut does not apply."""
    if not shortcut_applies(path):
        return {}
    tok, letters, find = load_tokenizer(path), _byte_letters(), pattern().findall
    strings = []
    for s in tok.get_vocab(with_added_tokens=False):
        try:
            text = bytes(letters[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if find(text) == [text]:
            strings.append(text)
    return {s: e.ids[0] for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1}


def odd_code_points(path: str, points=None) -> list[int]:
    """Code points around which the pattern and the library's splitter differ (checked over all of Unicode in tests)."""
    split, find, odd = load_tokenizer(path).pre_tokenizer.pre_tokenize_str, pattern().finditer, []
    for p in points if points is not None else (p for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF):
        c = chr(p)
        s = f"a{c}1{c}!{c}{c} {c}b "
        if [o for _, o in split(s)] != [m.span() for m in find(s)]:
            odd.append(p)
    return odd


class _Memory(dict):
    """Pre-token to value; values of pre-tokens that are not whole tokens come from the library's merges. A full young
    generation becomes the old one, whose entries are taken over when asked for, so frequent pre-tokens stay."""

    def __init__(self, whole: dict, merge):
        super().__init__(whole)
        self.whole, self.merge, self.old = whole, merge, {}

    def __missing__(self, token):
        value = self.old.get(token)
        if value is None:
            value = self.merge(token)
        if len(self) >= MEMORY // 2 + len(self.whole):
            self.old = dict(islice(self.items(), len(self.whole), None))
            self.clear()
            self.update(self.whole)
        self[token] = value
        return value


class PreTokenEncoder:
    """Counts or encodes texts as the library does, with the proven shortcut."""

    def __init__(self, whole: dict[str, int], name: str = BYTE_BPE):
        path = tokenizer_path(name)
        self.tok = load_tokenizer(path)
        self.special = specials(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.uncovered = regex.compile(f"[^{_COVERED}]").search
        self.merge = self.tok.model.tokenize
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.whole = whole

    @functools.cached_property
    def costs(self) -> _Memory:
        return _Memory(dict.fromkeys(self.whole, 1), lambda s: len(self._merged(s)))

    @functools.cached_property
    def bytes(self) -> _Memory:
        return _Memory({s: i.to_bytes(4, "little") for s, i in self.whole.items()}, lambda s: self._pack([t.id for t in self._merged(s)]))

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _merged(self, pre_token: str) -> list:
        """The library's merges on one pre-token, without its splitter."""
        return self.merge(pre_token.encode().decode("latin-1").translate(self.letters))

    def _splitter(self, text: str):
        """What finds the pre-tokens of a text; None if the library has to."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if self.uncovered(text) else pattern().findall
        return pattern().findall if _UNLIKE.search(text) else _LATIN.findall

    @staticmethod
    def _pack(ids) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _parts(self, text: str):
        """Stretches of plain text and special strings."""
        if self.cut is None or not any(s in text for s in self.special):
            return (text,)
        return [p for p in self.cut.split(text) if p]

    def count(self, text: str) -> int:
        find = self._splitter(text)
        if find is None:
            return len(self._ids(text))
        n, cost = 0, self.costs.__getitem__
        for part in self._parts(text):
            n += 1 if part in self.special else sum(map(cost, find(part)))
        return n

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        find = self._splitter(text)
        if find is None:
            return self._pack(self._ids(text))
        get = self.bytes.__getitem__
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(get, find(part)))
            for part in self._parts(text)
        )


class WholeTextEncoder:
    """Counts or encodes texts by their library alone: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            self._ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            tok = load_tokenizer(path)
            self._ids = lambda text: tok.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self._ids(text))

    def encode(self, text: str) -> bytes:
        return PreTokenEncoder._pack(self._ids(text))


def encoder_for(name: str, whole: dict[str, int]) -> PreTokenEncoder | WholeTextEncoder:
    return PreTokenEncoder(whole, name) if shortcut_applies(tokenizer_path(name)) else WholeTextEncoder(name)
