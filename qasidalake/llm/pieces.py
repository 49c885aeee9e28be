"""Cutting a text where no pre-token of the public pattern can cross, and a bounded cache for the parts."""

from __future__ import annotations

import re

#: White space under any of the libraries' readings, and invisible characters near it.
_SPACE = "\\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2028\u2029\u2060\ufeff"
_TWO = re.compile(f"[{_SPACE}] ")
_AFTER_WORD = re.compile(f"(?<=[^{_SPACE}]) ")


def split_at_spaces(text: str) -> list[str]:
    """``text`` cut before spaces that follow a character which is no white space.

    A pre-token has a space only at its start or among white space, so none
    crosses these cuts.  All parts but the first have lost their leading space.
    """
    return _AFTER_WORD.split(text) if _TWO.search(text) else text.split(" ")


class Remembered:
    """``make(part)`` for parts of texts, remembering the last some hundred thousand distinct ones.

    Two generations of at most ``most`` entries each; a part that is met again
    moves to the young one.  Long parts are never remembered.
    """

    def __init__(self, make, most: int = 150_000, longest: int = 48):
        self.make, self.most, self.longest = make, most, longest
        self.young, self.old = {}, {}

    def __call__(self, part):
        found = self.young.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                found = self.make(part)
                if len(part) > self.longest:
                    return found
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[part] = found
        return found

    def all(self, parts: list) -> list:
        """The values of ``parts``, in order."""
        young = self.young
        missing = set(parts).difference(young)
        if not missing:
            return list(map(young.__getitem__, parts))
        if len(young) + len(missing) > self.most:
            self.old, self.young = young, {}
            missing = set(parts)
        known = {p: self(p) for p in missing}
        if len(missing) <= self.most and all(len(p) <= self.longest for p in missing):
            return list(map(self.young.__getitem__, parts))
        held = self.young
        return [known[p] if p in known else held[p] for p in parts]
