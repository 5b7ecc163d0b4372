"""Exact tokenization of whole texts with a memo over their space-delimited parts.

No pre-token of the two vocabularies used here reaches from a visible character into white space that follows it,
nor from a letter or digit into a mark of punctuation, so a text's tokens are the tokens of its parts one after the
other: white space with the visible run after it, and the punctuation that ends a word apart from the word.
The library encodes each distinct part once per worker while the memo holds it: of two generations of ``MEMO`` parts (or as asked for),
the older goes when the younger is full, and parts in use move from the older to the younger.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Unicode White_Space, as the vocabularies' patterns see it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of these before one of ``MARKS`` is a part of its own (not U+0130, whose lower case ends in a mark).
LETTER, MARKS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f", ".,;:!?"
WORD = LETTER + "0-9"
PARTS = re.compile(f"[{SPACE}]*+[{WORD}]++(?=[{MARKS}])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
VISIBLE = re.compile(f"[{WORD}]++(?=[{MARKS}])|[^{SPACE}]+")
#: Distinct parts in a generation of a worker's memo, and the longest part that it remembers.
MEMO, LONGEST = 150_000, 64

_loaded: dict[str, object] = {}


def vocabulary(path: str):
    """The tokenizer of a ``.json`` file, loaded once per worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Values of parts by ``compute`` (a list of distinct parts to a list of values)."""

    def __init__(self, compute: Callable[[list[str]], list], size: int = MEMO):
        self.compute, self.size, self.known, self.older = compute, size, {}, {}

    def values(self, parts: list[str]) -> list:
        known, older = self.known, self.older
        if missing := {p for p in parts if p not in known}:
            if len(known) + len(missing) > self.size:
                older = self.older = known
                known = self.known = {}
                missing = set(parts)
            new = []
            for p in missing:
                if (value := older.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = value
            known.update(zip(new, self.compute(new), strict=True))
            out = [known[p] for p in parts]
            for p in new:
                if len(p) > LONGEST:
                    del known[p]
            return out
        return [known[p] for p in parts]
