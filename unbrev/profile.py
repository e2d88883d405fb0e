"""Alphabet profiles.

A profile holds the fixed language values every column builder needs: the
letters, which of them are vowels or silent signs, how spelling variants fold,
where keys sit on the keyboard, and which endings route an input.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True)
class Profile:
    name: str
    letters: str  # letters left after folding
    vowels: str
    signs: str
    fold_from: str
    fold_to: str
    keyboard: tuple[str, ...]
    endings: tuple[str, ...]
    government: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def letter_class(self) -> str:
        """Regex class body matching one normalised letter."""
        return f"{self.letters[0]}-{self.letters[-1]}"

    @cached_property
    def raw_letter_class(self) -> str:
        """Regex class body matching one letter before normalisation."""
        extra = "".join(dict.fromkeys(self.fold_from + self.fold_from.upper()))
        extra = "".join(c for c in extra if len(c) == 1)
        return self.letter_class + self.letter_class.upper() + extra

    def normalize(self, word: str) -> str:
        """Plain-Python twin of the ``normalize`` column (small values only)."""
        return word.lower().translate(str.maketrans(self.fold_from, self.fold_to))

    def adjacent(self, a: str, b: str) -> bool:
        spots = self._key_spots
        if a == b or a not in spots or b not in spots:
            return False
        (row_a, col_a), (row_b, col_b) = spots[a], spots[b]
        rows, cols = abs(row_a - row_b), abs(col_a - col_b)
        return cols <= 1 if rows == 1 else rows == 0 and cols == 1

    @cached_property
    def _key_spots(self) -> dict[str, tuple[int, int]]:
        return {
            letter: (r, c)
            for r, keys in enumerate(self.keyboard)
            for c, letter in enumerate(keys)
        }

    @cached_property
    def neighbours(self) -> dict[str, str]:
        """Letter to the string of letters on neighbouring keys."""
        found = {
            a: "".join(b for b in self.letters if self.adjacent(a, b))
            for a in self.letters
        }
        return {a: near for a, near in found.items() if near}


# Russian letters, keyboard, endings and the cases that
# prepositions govern.
RU = Profile(
    name="ru",
    letters="абвгдежзийклмнопрстуфхцчшщъыьэюя",
    vowels="аеёиоуыэюя",
    signs="ьъ",
    fold_from="ё",
    fold_to="е",
    keyboard=("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"),
    endings=(
        "ование", "ение", "ание", "ние", "ция", "ость",
        "ться", "ство", "ать", "ить", "еть", "ия",
    ),
    government={
        **dict.fromkeys(("в", "во", "на"), ("loct", "accs")),
        **dict.fromkeys(("о", "об", "обо", "при"), ("loct",)),
        **dict.fromkeys(
            (
                "для", "без", "безо", "до", "из", "изо", "из-за", "из-под",
                "от", "ото", "у", "около", "возле", "кроме", "ради", "вместо",
                "вокруг", "после", "против", "среди", "сверх",
            ),
            ("gent",),
        ),
        **dict.fromkeys(
            ("к", "ко", "благодаря", "вопреки", "согласно", "навстречу"),
            ("datv",),
        ),
        "по": ("datv", "loct", "accs"),
        **dict.fromkeys(("с", "со"), ("ablt", "gent")),
        **dict.fromkeys(
            ("над", "надо", "под", "подо", "перед", "передо", "между", "меж"),
            ("ablt",),
        ),
        "за": ("ablt", "accs"),
        **dict.fromkeys(("про", "через", "черезо", "сквозь"), ("accs",)),
    },
)

# The Latin-script profile used for en/de/fr/es text.
LATIN = Profile(
    name="latin",
    letters="abcdefghijklmnopqrstuvwxyz",
    vowels="aeiouy",
    signs="",
    fold_from="àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß",
    fold_to="aaaaaaaceeeeiiiinooooooouuuuyys",
    keyboard=("qwertyuiop", "asdfghjkl", "zxcvbnm"),
    endings=(
        "ation", "ment", "ness", "tion", "sion", "ance",
        "ence", "able", "ing", "eux", "ed", "en",
    ),
)

# Grammeme spellings of the six cases, in paradigm order.
CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct")
CASE_ALIASES = {
    "nomn": "nomn",
    "gent": "gent", "gen1": "gent", "gen2": "gent",
    "datv": "datv",
    "accs": "accs", "acc2": "accs",
    "ablt": "ablt",
    "loct": "loct", "loc1": "loct", "loc2": "loct",
}
