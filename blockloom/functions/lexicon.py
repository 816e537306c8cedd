"""Known words: stems of Uzbek (in Latin) and Russian, from a table; without one, no word is known."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import chars
from .scripts import latin


@dataclass(frozen=True)
class Language:
    stems: frozenset[str] = frozenset()
    endings: tuple[str, ...] = ()
    rounds: int = 1

    def knows(self, word: str, least: int) -> bool:
        return word in self.stems or self.stem(word, least) in self.stems

    def stem(self, word: str, least: int) -> str:
        """Without its longest listed ending, as often as ``rounds`` says."""
        by_length = sorted(self.endings, key=len, reverse=True)
        for _ in range(self.rounds):
            end = next((e for e in by_length if word.endswith(e) and len(word) - len(e) >= least), None)
            if end is None:
                break
            word = word[: len(word) - len(end)]
        return word


@dataclass(frozen=True)
class Lexicon:
    uzbek: Language = field(default_factory=Language)
    russian: Language = field(default_factory=Language)
    least_stem: int = 4

    def __bool__(self) -> bool:
        return bool(self.uzbek.stems or self.russian.stems)

    def knows(self, word: str) -> bool:
        word = "".join("'" if c in chars.APOSTROPHES else c for c in word).lower().strip("'")
        if not word or not self:
            return False
        if not any(map(chars.is_cyrillic, word)):
            return self.uzbek.knows(word, self.least_stem)
        return self.russian.knows(word.replace("ё", "е"), self.least_stem) or self.uzbek.knows(latin(word), self.least_stem)


EMPTY = Lexicon()
