"""A bounded memo for values of frequent words."""

from __future__ import annotations


class Memo:
    """Holds at most two generations of ``cap`` entries; what is not used for a generation goes."""

    def __init__(self, cap: int = 200_000):
        self.cap, self.young, self.old = cap, {}, {}

    def values(self, keys: list, make) -> list:
        """The keys' values; ``make(list of distinct missing keys)`` gives theirs."""
        got = list(map(self.young.get, keys))
        if None in got:
            if len(self.young) >= self.cap:
                self.young, self.old = {}, self.young
            young, old = self.young, self.old
            missing = [i for i, v in enumerate(got) if v is None]
            new = {}
            for i in missing:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    new[k] = None
                else:
                    young[k] = v
            if new:
                young.update(zip(new, make(list(new)), strict=True))
            for i in missing:
                k = keys[i]
                v = young.get(k)
                got[i] = old[k] if v is None else v
        return got
