"""What the two sentencepiece operators share: the vocabulary of a merge-type
model file, and the units into which a text falls.

The installed library only reads the model file (pieces, scores, kinds); text is
never encoded with it. White space is written as U+2581. As no piece holds that
mark after another character, merges never cross a place where a mark follows
something else; nor do they cross two characters that are neighbours in no piece,
such as a letter and a full stop; and none ever touches a character that is in no
piece. So a text can be cut at such places into units that encode on their own,
and units repeat.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

MARK = "▁"
LETTER = re.compile("[A-Za-z\u00c0-\u024f]")


class Vocabulary:
    """Pieces of a merge-type (BPE) model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.control: set[int] = set()
        for i, p in enumerate(self.text):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.control.add(i)
            else:
                self.id[p], self.score[p] = i, model.get_score(i)
        # Rank: place in the order of scores; equal scores have equal ranks.
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in self.score.items()}
        self.bos, self.eos = model.bos_id(), model.eos_id()
        if len(self.byte_of) != 256:
            raise ValueError("the model has no byte pieces")
        inner = re.compile(f"[^{MARK}]{MARK}")
        if any(inner.search(p) for p in self.id):
            raise ValueError("a piece holds a space mark after another character")
        self.letters = set("".join(self.id))
        # Signs that follow a letter in no piece: between a letter and one of them no merge can reach.
        follow = {b for p in self.id for a, b in zip(p, p[1:]) if LETTER.match(a)}
        signs = re.escape("".join(c for c in string.punctuation if c not in follow))
        rest = f"{MARK}\n" if "\n" not in self.letters else MARK  # a line break in no piece is a unit of its own
        self.unit = re.compile((f"{MARK}*{LETTER.pattern}+(?=[{signs}])|" if signs else "") + f"{MARK}*[^{rest}]+|{MARK}+|\n")

    def units(self, text: str) -> list[str]:
        """Units of a text as the library sees it: a mark before it (unless it is
        empty) and marks for spaces."""
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One copy per path and Python worker."""
    return Vocabulary(path)


class Kept(dict):
    """Results per unit, made on first sight. Forgotten when they take more than
    ``limit`` characters, so that memory is bounded."""

    def __init__(self, make, limit: int = 8 << 20):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def __missing__(self, unit: str):
        value = self.make(unit)
        if self.held > self.limit:
            self.forget()
        self.held += len(unit) + 16
        self[unit] = value
        return value
