"""Affix dictionaries: a list of stems with flags, and a table of what each flag may add.

The affix table is of a language's size and is read to the driver; the stems are a table of
any size, and its rows are expanded where they lie: every stem, every form that a rule of
one of its flags makes of it, what flags of the added part make of that, and a prefix with a
suffix where both allow it. Flags are characters, pairs of characters or numbers. A
condition looks at the letters that the rule touches. Stems flagged as never alone, and
words flagged as forbidden, aren't words; what else a table may hold is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.normalize import folded_word
from scriptorium.sources.tables import HEADER_REPAIR

_SPLIT = re.compile(r"(?<!\\)/")


@dataclass(frozen=True)
class Rule:
    strip: str
    add: str
    more: frozenset[str]
    condition: re.Pattern


@dataclass
class Affix:
    suffix: bool
    cross: bool
    rules: list[Rule] = field(default_factory=list)


@dataclass
class AffixTable:
    affixes: dict[str, Affix]
    kind: str = "char"
    needs_affix: str | None = None
    forbidden: str | None = None

    def flags(self, text: str) -> frozenset[str]:
        if self.kind == "num":
            return frozenset(x for x in text.split(",") if x)
        size = 2 if self.kind == "long" else 1
        return frozenset(text[i : i + size] for i in range(0, len(text), size))

    @staticmethod
    def _applied(rule: Rule, suffix: bool, word: str) -> str | None:
        """The word with the rule's part in place of what it strips; a whole word isn't stripped."""
        if len(word) <= len(rule.strip) or not rule.condition.search(word):
            return None
        if suffix:
            return word[: len(word) - len(rule.strip)] + rule.add if word.endswith(rule.strip) else None
        return rule.add + word[len(rule.strip) :] if word.startswith(rule.strip) else None

    def _made(self, word: str, flags: Iterable[str], suffix: bool, crossing: bool = False) -> Iterator[tuple[str, Rule]]:
        for f in sorted(flags):
            a = self.affixes.get(f)
            if a and a.suffix == suffix and (a.cross or not crossing):
                yield from ((new, r) for r in a.rules if (new := self._applied(r, suffix, word)) is not None)

    def forms(self, stem: str, flags: frozenset[str]) -> set[str]:
        if self.forbidden in flags:
            return set()
        hidden = lambda more: self.needs_affix in more
        out = set() if hidden(flags) else {stem}
        ended = [(stem, frozenset(), False)]
        for word, r in self._made(stem, flags, True):
            crosses = any(a.suffix and a.cross and r in a.rules for f in flags if (a := self.affixes.get(f)))
            ended.append((word, r.more, crosses))
            for twice, s in self._made(word, r.more, True):
                ended.append((twice, s.more, crosses))
        for word, more, crosses in ended:
            if word != stem and not hidden(more):
                out.add(word)
            # A prefix on the stem itself always; on a form, if both the suffix and the prefix may cross.
            heads = self._made(word, flags if word == stem else flags | more, False, crossing=word != stem)
            if word == stem or crosses:
                out |= {w for w, r in heads if not hidden(r.more)}
        return out


def affix_table(lines: Iterable[str]) -> AffixTable:
    """The table in these lines; ValueError if a flag has fewer or more rules than its header says."""
    out = AffixTable({})
    expected: dict[str, int] = {}
    for line in lines:
        p = HEADER_REPAIR.sub(r"\1", line.rstrip("\n")).split()
        if not p or p[0].startswith("#"):
            continue
        if p[0] == "FLAG" and len(p) > 1:
            out.kind = {"num": "num", "long": "long"}.get(p[1], "char")
        elif p[0] in ("NEEDAFFIX", "PSEUDOROOT"):
            out.needs_affix = p[1]
        elif p[0] == "FORBIDDENWORD":
            out.forbidden = p[1]
        elif p[0] in ("SFX", "PFX") and len(p) == 4 and p[2] in "YN" and p[3].isdigit():
            out.affixes[p[1]], expected[p[1]] = Affix(p[0] == "SFX", p[2] == "Y"), int(p[3])
        elif p[0] in ("SFX", "PFX") and len(p) >= 4:
            if p[1] not in out.affixes:
                raise ValueError(f"flag {p[1]!r} has a rule before its header")
            add, _, more = p[3].partition("/")
            condition = p[4] if len(p) > 4 else "."
            # `-` is a letter in a condition's class, and so is every other sign but . [ ] ^.
            pattern = "".join(x if x in ".[]" or (x == "^" and i and condition[i - 1] == "[") else re.escape(x) for i, x in enumerate(condition))
            zero = lambda s: "" if s == "0" else folded_word(s)
            out.affixes[p[1]].rules.append(Rule(zero(p[2]), zero(add), out.flags(more), re.compile(f"(?:{pattern})$" if p[0] == "SFX" else f"^(?:{pattern})")))
    wrong = sorted(f for f, n in expected.items() if len(out.affixes[f].rules) != n)
    if wrong:
        raise ValueError(f"flags {wrong} don't have the rules that their headers say")
    return out


def dictionary(spark: SparkSession, aff: str, dic: str) -> DataFrame:
    """(word): every form of the dictionary once. Lines of dic are stems with flags after a slash; its first is their number."""
    table = affix_table(r["value"] for r in spark.read.text(aff).coalesce(1).toLocalIterator())

    def expand(xs: pd.Series) -> pd.Series:
        def one(line: str) -> list[str]:
            entry, *flags = _SPLIT.split(re.split(r"[\t ]", line, maxsplit=1)[0], maxsplit=1)
            return sorted(table.forms(folded_word(entry.replace("\\/", "/")), table.flags(flags[0] if flags else "")))

        return xs.map(one)

    lines = spark.read.text(dic).filter((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*[0-9]+\s*$") & ~F.col("value").startswith("#"))
    return lines.select(F.explode(F.pandas_udf(expand, "array<string>")("value")).alias("word")).filter("word <> ''").distinct()
