"""Where the characters of a changed text come from, as breakpoints.

Between two breakpoints origins go on by one a character, or, in what a whole passage
became, stay the same. So a map has entries for changes, not for characters; a place is
found by binary search. A pass over a text gives its changes, and the map of all passes so
far is carried over them in one walk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: As a column: from `place` on, origins go on from `origin` by `step` a character.
OFFSETS_DDL = "array<struct<place:int,origin:int,step:int>>"

#: start, end, and for each new character the place within the old ones that it comes from.
Change = tuple[int, int, tuple[int, ...]]


class Offsets:
    """The map of a text of `size` characters; its end has an origin too."""

    __slots__ = ("size", "places", "origins", "steps")

    def __init__(self, size: int, places: list[int] | None = None, origins: list[int] | None = None, steps: list[int] | None = None):
        self.size = size
        self.places, self.origins, self.steps = (places, origins, steps) if places is not None else ([0], [0], [1])

    @classmethod
    def flat(cls, size: int, end: int) -> Offsets:
        """All characters come from the first; the end from `end`."""
        return cls(size, [0, size], [0, end], [0, 1]) if size else cls(0, [0], [end], [1])

    def __getitem__(self, place: int) -> int:
        place = min(place, self.size)
        i = bisect_right(self.places, place) - 1
        return self.origins[i] + self.steps[i] * (place - self.places[i])

    def __len__(self) -> int:
        """Breakpoints."""
        return len(self.places)

    def expanded(self) -> list[int]:
        """The origin of every character, and of the end."""
        return [self[i] for i in range(self.size + 1)]

    def rows(self) -> list[tuple[int, int, int]]:
        return list(zip(self.places, self.origins, self.steps, strict=True))

    def over(self, changes: Iterable[Change]) -> Offsets:
        """The map after these changes, which are in order and don't overlap."""
        out = Offsets(0, [], [], [])
        at = seg = 0
        for start, end, local in changes:
            seg = self._copied(out, at, start, seg)
            for i in local:
                out._run(out.size, self[start + i], 1, 1)
                out.size += 1
            at = end
        self._copied(out, at, self.size, seg)
        out._run(out.size, self[self.size], 1, 1)
        return out

    def _copied(self, out: Offsets, start: int, end: int, seg: int) -> int:
        """Adds what stays between two places; seg is a breakpoint not beyond start, and so is what is returned for what follows."""
        while start < end:
            while seg + 1 < len(self.places) and self.places[seg + 1] <= start:
                seg += 1
            stop = min(end, self.places[seg + 1]) if seg + 1 < len(self.places) else end
            out._run(out.size, self.origins[seg] + self.steps[seg] * (start - self.places[seg]), self.steps[seg], stop - start)
            out.size += stop - start
            start = stop
        return seg

    def _run(self, place: int, origin: int, step: int, n: int) -> None:
        """n characters from place on; no breakpoint where the last one goes on like that."""
        if self.places and self.origins[-1] + self.steps[-1] * (place - self.places[-1]) == origin and (n == 1 or self.steps[-1] == step):
            return
        self.places.append(place)
        self.origins.append(origin)
        self.steps.append(step)


def remapped(place: Column, offsets: Column, size: Column) -> Column:
    """A place of the changed text, of `size` characters, in the submitted one: binary search in the breakpoints, null if there are none."""
    at = F.least(place, size).cast("int")
    halved = F.sequence(F.lit(1), F.ceil(F.log2(F.size(offsets) + 1)).cast("int"))
    # lo's breakpoint isn't beyond the place, hi's is.
    def narrower(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(offsets, mid)["place"] <= at
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    found = F.aggregate(halved, F.struct(F.lit(0).alias("lo"), F.size(offsets).alias("hi")), narrower, lambda s: F.get(offsets, s["lo"]))
    return (found["origin"] + found["step"] * (at - found["place"])).cast("int")
