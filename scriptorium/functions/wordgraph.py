"""A minimal acyclic automaton of a word list, walked with an edit automaton.

The graph shares beginnings and endings of words, so that 150,000 words take some tens
of thousands of nodes. The edit automaton stands for all words within so many edits of
one word, an edit being an insertion, a deletion, a replacement or a swap of neighbours.
Its states are sets of (letters of the word used, edits so far), written relative to the
least of the letters used; a step depends on a state and on where, in the next few
letters of the word, the letter of the graph's edge stands. Neither depends on the word,
so that steps are worked out once for all words and looked up from then on. Both are
walked together, depth first, and a branch ends where no state is left or no word of a
fitting length lies beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

#: Letters of the word used beyond the state's least, edits, and whether half of a swap is done.
Place = tuple[int, int, bool]


class EditAutomaton:
    """The states and steps for up to `most` edits."""

    def __init__(self, most: int):
        self.most, self.window = most, (1 << (3 * most + 2)) - 1
        self.number: dict[frozenset[Place], int] = {}
        self.places: list[frozenset[Place]] = []
        self.steps: list[_Steps] = []
        #: Where the next letter must stand, if every place of the state has all its edits.
        self.spots: list[tuple[int, ...]] = []
        #: What may still follow in the graph, relative to what is left of the word: at least, at most.
        self.least: list[int] = []
        self.longest: list[int] = []
        self.cut: dict[tuple[int, int, int], tuple[int, int] | None] = {}
        self.start = self._state(frozenset({(0, 0, False)}))

    def _state(self, places: frozenset[Place]) -> int:
        if places not in self.number:
            self.number[places] = len(self.places)
            self.places.append(places)
            self.steps.append(_Steps(self, len(self.places) - 1))
            self.spots.append(tuple({i for i, _, _ in places}))
            self.least.append(min(-i - (self.most - e) for i, e, _ in places))
            self.longest.append(max(-i + (self.most - e) for i, e, _ in places))
        return self.number[places]

    def step(self, state: int, stands: int) -> tuple[int, int] | None:
        """The next state and how far its least moves on, for a letter that stands at these bits of the word from the state's least on."""
        out: set[Place] = set()
        for i, e, half in self.places[state]:
            at = stands >> i
            if half:
                if at & 1:
                    out.add((i + 2, e, False))
                continue
            for skip in range(self.most - e + 1):  # letters of the word that the other lacks
                if at >> skip & 1:
                    out.add((i + skip + 1, e + skip, False))
                if e + skip < self.most and at >> skip >> 1 & 1:
                    out.add((i + skip, e + skip + 1, True))
            if e < self.most:
                out |= {(i, e + 1, False), (i + 1, e + 1, False)}
        # A place that another reaches with fewer edits adds nothing.
        kept = {(i, e, h) for i, e, h in out if not any(f < e and (abs(i - j) <= e - f and not h or h and i == j) for j, f, g in out if g == h)}
        if not kept:
            return None
        low = min(i for i, _, _ in kept)
        return self._state(frozenset((i - low, e, h) for i, e, h in kept)), low

    def allowed(self, step: tuple[int, int], gap: int, limit: int) -> tuple[int, int] | None:
        """The step without places of more than `limit` edits before `gap` letters are used. A swap that is half done counts where it ends."""
        state, moved = step
        key = (state, min(gap - moved, 3 * self.most), limit)
        if key not in self.cut:
            stay = {(i, e, h) for i, e, h in self.places[state] if e <= limit or i + h >= gap - moved}
            low = min((i for i, _, _ in stay), default=0)
            self.cut[key] = (self._state(frozenset((i - low, e, h) for i, e, h in stay)), low) if stay else None
        cut = self.cut[key]
        return cut and (cut[0], moved + cut[1])

    def distance(self, state: int, left: int) -> int | None:
        """Edits if the other word ends here, with `left` letters of the word beyond the state's least; None if too many."""
        found = [e + left - i for i, e, half in self.places[state] if not half and 0 <= left - i <= self.most - e]
        return min(found, default=None)


class _Steps(dict):
    """The steps of one state, worked out when first taken."""

    def __init__(self, of: EditAutomaton, state: int):
        self.of, self.state = of, state

    def __missing__(self, stands: int) -> tuple[int, int] | None:
        self[stands] = out = self.of.step(self.state, stands)
        return out


@lru_cache(maxsize=8)
def automaton(most: int) -> EditAutomaton:
    return EditAutomaton(most)


class Graph:
    """The minimal acyclic automaton of some words; words are added in order, and equal endings are one."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        #: Letters from a node to the nearest and farthest end of a word.
        self.nearest: list[int] = []
        self.farthest: list[int] = []
        known: dict[tuple, int] = {}

        def settled(edges: dict[str, int], final: bool) -> int:
            key = (final, *edges.items())
            if key not in known:
                known[key] = len(self.edges)
                self.edges.append(edges)
                self.final.append(final)
                below = edges.values()
                self.nearest.append(0 if final else min((self.nearest[n] + 1 for n in below), default=0))
                self.farthest.append(max((self.farthest[n] + 1 for n in below), default=0))
            return known[key]

        # The path of the last word: what branches off it can still change, all else is settled.
        path: list[tuple[dict[str, int], bool]] = [({}, False)]

        def close(before: str, shared: int) -> None:
            while len(path) - 1 > shared:
                edges, final = path.pop()
                path[-1][0][before[len(path) - 1]] = settled(edges, final)

        before = ""
        for word in sorted(words):
            shared = 0
            while shared < len(before) and shared < len(word) and before[shared] == word[shared]:
                shared += 1
            close(before, shared)
            path += [({}, False) for _ in word[shared:]]
            path[-1] = (path[-1][0], True)
            before = word
        close(before, 0)
        self.root = settled(*path[0])

    def __contains__(self, word: str) -> bool:
        node: int | None = self.root
        for c in word:
            node = self.edges[node].get(c)
            if node is None:
                return False
        return self.final[node]

    def near(self, word: str, most: int, bound: int = 0, limit: int = 0) -> Iterator[tuple[str, int]]:
        """The words within `most` edits of word, each with its edits, of which at most `limit` are in its first `bound` letters."""
        a = automaton(most)
        edges, final, nearest, farthest, steps, spots, least, longest, window = self.edges, self.final, self.nearest, self.farthest, a.steps, a.spots, a.least, a.longest, a.window
        stands: dict[str, int] = {}
        for i, c in enumerate(word):
            stands[c] = stands.get(c, 0) | 1 << i
        size, ahead, padded = len(word), 3 * most + 2, word + "\0" * (5 * most + 1)
        todo = [(self.root, a.start, 0, "")]
        while todo:
            node, state, at, so_far = todo.pop()
            if final[node] and (d := a.distance(state, size - at)) is not None:
                yield so_far, d
            own, here = edges[node], steps[state]
            # Where a letter that isn't near in the word leads nowhere, only those that are need a look.
            if (other := here[0]) is None:
                letters: Iterable[str] = {padded[at + i] for i in spots[state]}
            elif at + other[1] < bound and (other := a.allowed(other, bound - at, limit)) is None:
                letters = {*padded[at : at + ahead]}
            else:
                letters = own
            for c in letters:
                child = own.get(c)
                if child is None:
                    continue
                bits = stands.get(c, 0) >> at & window
                if bits:
                    step = here[bits]
                    if step and at + step[1] < bound:
                        step = a.allowed(step, bound - at, limit)
                else:
                    step = other
                if step:
                    new, moved = step
                    rest = size - at - moved
                    if farthest[child] >= rest + least[new] and nearest[child] <= rest + longest[new]:
                        todo.append((child, new, at + moved, so_far + c))


class WordGraph:
    """Words by their beginnings and by their ends."""

    def __init__(self, words: Iterable[str]):
        words = set(words)
        self.forth, self.back = Graph(words), Graph(w[::-1] for w in words)

    def __contains__(self, word: str) -> bool:
        return word in self.forth

    def near(self, word: str, most: int = 2) -> dict[str, int]:
        """The words within `most` edits of word, each with its edits."""
        if most != 2 or len(word) < 4:
            return dict(self.forth.near(word, most))
        half = len(word) // 2
        out = dict(self.forth.near(word, most, half, 1))
        for x, d in self.back.near(word[::-1], most, len(word) - half, 0):
            x = x[::-1]
            out[x] = min(d, out.get(x, d))
        return out


@lru_cache(maxsize=4)
def word_graph(words: frozenset[str]) -> WordGraph:
    """The graph of a word list, made once a Python process."""
    return WordGraph(words)
