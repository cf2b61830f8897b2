"""Detectors of stage 1: one pass over a document's sentences and tokens.

Each document is checked where it lies: all tables of a pack are of fixed size
and travel with the code, so a corpus is checked without any shuffle. A detector
takes the words of a sentence and yields edits in the order in which it finds
them; that order is the last key when edits overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache, reduce
from heapq import nsmallest
from itertools import accumulate, islice
from operator import or_
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.config import CONFIDENCE, EDIT_DDL, PipelineConfig
from scriptorium.functions.distance import osa
from scriptorium.functions.letters import BLOCK, DANDA, DOUBLE_DANDA
from scriptorium.functions.normalize import folded_word, normalize
from scriptorium.functions.offsets import OFFSETS_DDL
from scriptorium.functions.pieces import of_batch, of_series
from scriptorium.functions.tokenize import sentences
from scriptorium.functions.wordgraph import WordGraph, word_graph
from scriptorium.operators.lexicon import Lexicon
from scriptorium.operators.resolve import chosen
from scriptorium.packs.base import Pack


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    original: str
    suggestions: tuple[str, ...]
    error_class: str
    confidence: float
    rule: str

    def __post_init__(self) -> None:
        if self.start < 0 or self.end < self.start or not 0 <= self.confidence <= 1:
            raise ValueError(f"not an edit: {self}")


class Word(NamedTuple):
    start: int
    end: int
    text: str


def edit(w: Word, suggestions, error_class: str, rule: str, confidence: float | None = None) -> Edit:
    c = CONFIDENCE[rule] if confidence is None else confidence
    return Edit(w.start, w.end, w.text, tuple(s for s in suggestions if s), error_class, min(1.0, max(0.0, c)), rule)


# Marks, and what the patterns of punctuation take for a mistake.
MARKS = re.escape(DANDA + DOUBLE_DANDA) + ",;:?!"
#: rule, pattern, what replaces the match. Bengali script only where it says so.
PUNCTUATION = (
    ("space_before", re.compile(f"[ \\t]+([{MARKS}])"), lambda m: m.group(1)),
    ("missing_space", re.compile(f"([{MARKS}])(?=[{BLOCK}])"), lambda m: m.group(1) + " "),
    ("repeated_mark", re.compile(f"([{MARKS}])\\1+"), lambda m: m.group(1)),
    ("multiple_spaces", re.compile("(?<=\\S)[ \\t]{2,}(?=\\S)"), lambda m: " "),
    ("latin_period", re.compile(f"(?<=[{BLOCK}])[ ]?\\.(?=\\s|\\Z)"), lambda m: DANDA),
)


#: What a word can have that a detector looks for, and the detectors that have nothing to do in a sentence without it.
SPELLED, JOINED, COUNTED, SWAPPED, PLURAL, OWNER, STANDARD, MARKED = (1 << n for n in range(8))
TRAITS = {"spelling": SPELLED, "collocation": JOINED, "classifier": COUNTED | SWAPPED | PLURAL | OWNER, "standard": STANDARD, "register": MARKED}
#: The rules of a sentence's detectors, and that of a whole text's.
RULES = {
    "spelling": {"violation", "unknown_with_suggestions", "unknown_alone"}, "collocation": {"collocation"}, "verb_person": {"verb_person"},
    "classifier": {"double_plural", "animacy", "animate_plural", "possessive"}, "standard": {"standard_form"}, "register": {"register_clash"}, "drift": {"register_drift"},
}


def punctuation(text: str, rules: frozenset[str] | None = None) -> Iterator[Edit]:
    for rule, pattern, fix in PUNCTUATION:
        if rules is not None and rule not in rules:
            continue
        for m in pattern.finditer(text):
            yield edit(Word(m.start(), m.end(), m.group()), (fix(m),), "PUNCTUATION", rule)


@dataclass
class Checker:
    """A pack's tables in the form that detectors read."""

    pack: Pack
    budget: int = 25
    lexicon: Lexicon = field(init=False)

    def __post_init__(self) -> None:
        p = self.pack
        self.lexicon = Lexicon(p)
        # Earlier words of the pack's list count as more frequent.
        self.frequency = {folded_word(w): len(p.lexicon) - i for i, w in enumerate(p.lexicon)}
        # Words repeat: what depends on a word alone is worked out once, for as many words as a language has in use.
        self.suggest, self.lookup, self.own_register, self.plural_of, self.traits_of = (lru_cache(maxsize=100_000)(f) for f in (self._suggest, self.lexicon.lookup, self._register_of, self._plural_of, self._traits_of))
        self.wrong = {c.wrong for c in p.collocations}
        self.modern_of, self.archaic_of = p.register, {v: k for k, v in reversed(p.register.items())}
        endings: dict[str, set[tuple[str, str]]] = {}
        for tense, cells in p.paradigms.items():
            for person, ending in cells.items():
                if ending not in p.ambiguous_endings:
                    endings.setdefault(ending, set()).add((tense, person))
        self.endings = sorted(endings.items(), key=lambda x: (-len(x[0]), x[0]))

    @cached_property
    def graph(self) -> WordGraph:
        return word_graph(self.lexicon.words)

    def ranked(self, word: str, near: Iterable[tuple[str, int]], limit: int) -> list[str]:
        """The best of some words with their edits: by edits, one letter of the same sound, length gap, key, frequency, then code point."""
        key, alike, own = self.pack.sounds.key, self.pack.sounds.alike, self.pack.sounds.key(word)
        rows = ((d, not alike(word, w), abs(len(w) - len(word)), key(w) != own, -self.frequency.get(w, 0), w) for w, d in near if w != word)
        return [x[-1] for x in nsmallest(limit, rows)]

    def stems(self, word: str, limit: int, most_splits: int = 4) -> Iterator[str]:
        """Words of an unknown stem's sound near it, with the suffix again."""
        key = self.pack.sounds.key
        unknown = ((stem, s) for stem, s in self.lexicon.splits(word) if not self.lookup(stem).known)
        for stem, s in islice(unknown, most_splits):
            same = ((w, d) for w, d in self.graph.near(stem).items() if key(w) == key(stem))
            yield from (w + s for w in self.ranked(stem, same, limit))

    def _suggest(self, word: str, limit: int = 5) -> list[str]:
        """The nearest words within two edits, of the word graph and of stems with their suffix again."""
        near = self.graph.near(word)
        for w in self.stems(word, limit):
            if w not in near and (d := osa(word, w, 2)) <= 2:
                near[w] = d
        return self.ranked(word, near.items(), limit)

    def register_of(self, word: str, before: str | None) -> str | None:
        """archaic, modern or None; a word that only some neighbours mark is modern after one of them."""
        return self.own_register(word) or ("modern" if word in self.pack.contextual and before in self.pack.contextual[word][1] else None)

    def _register_of(self, word: str) -> str | None:
        p = self.pack
        if word in p.register:
            return "archaic"
        if any(word.endswith(e) and len(word) > len(e) for e in p.archaic_endings):
            return "archaic"
        if any(word.endswith(e) and len(word) > len(e) for e in p.priority_modern):
            return "modern"
        for e in p.guarded_endings:
            stem = word[: -len(e)]
            if word.endswith(e) and len(stem) >= 2:
                return "archaic" if stem in p.register_verbs else None
        if word in self.archaic_of or any(word.endswith(e) and len(word) > len(e) + 1 for e in p.modern_endings):
            return "modern"
        return None

    def counterpart(self, word: str, register: str) -> str | None:
        if register == "modern":
            return self.archaic_of.get(word) or self.pack.contextual.get(word, (None,))[0]
        if word in self.modern_of:
            return self.modern_of[word]
        # By its longest ending; if that has no modern form, there is none.
        e = max((e for e in (*self.pack.archaic_endings, *self.pack.guarded_endings) if word.endswith(e)), key=len, default=None)
        return word[: -len(e)] + self.pack.derived[e] if e in self.pack.derived and len(word) - len(e) >= 2 else None

    def _traits_of(self, word: str) -> int:
        """What detectors look for in a word, whatever stands around it."""
        p = self.pack
        plural = self.person_plural(word)
        found = {
            SPELLED: self.lexicon.has_letter(word) and (word in p.violations or not (word in p.standard_forms or self.lookup(word).known)), JOINED: word in self.wrong, COUNTED: word in p.quantifiers,
            SWAPPED: word in p.thing_to_person or word in p.person_to_thing, PLURAL: plural in p.thing_nouns and word not in p.subjects, OWNER: word in p.possessives or plural in p.person_nouns,
            STANDARD: word in p.standard_forms, MARKED: word in p.contextual or self.own_register(word) is not None,
        }
        return sum(t for t, there in found.items() if there)

    def spelling(self, ws: list[Word], calls: list[int]) -> Iterator[Edit]:
        p = self.pack
        for i, w in enumerate(ws):
            if not self.traits_of(w.text) & SPELLED:
                continue
            if w.text in p.violations:
                yield edit(w, (p.violations[w.text],), "NOTVA_SHOTVA", "violation")
            elif w.text in p.standard_forms or self.lookup(w.text).known or self.register_of(w.text, ws[i - 1].text if i else None) == "archaic":
                continue
            else:
                found: list[str] = []
                if calls[0] < self.budget:
                    calls[0] += 1
                    found = self.suggest(w.text)
                rule = "unknown_with_suggestions" if found else "unknown_alone"
                yield edit(w, found, "NON_WORD", rule, CONFIDENCE[rule] * (1.0 if p.coverage is None else p.coverage))

    def collocation(self, ws: list[Word]) -> Iterator[Edit]:
        for i, w in enumerate(ws):
            for c in self.pack.collocations:
                after = ws[i + 1].text if i + 1 < len(ws) else None
                before = ws[i - 1].text if i else None
                if w.text == c.wrong and (after in c.before or before in c.after):
                    yield edit(w, (c.right,), "HOMONYM", "collocation", c.confidence)

    def verb(self, word: str, final: bool) -> tuple[str, str, set[tuple[str, str]]] | None:
        """(root, ending, cells) by the longest ending on a listed root."""
        for ending, cells in self.endings:
            if word.endswith(ending) and word[: -len(ending)] in self.pack.roots and word not in self.pack.not_verbs and (final or ending not in self.pack.final_only):
                return word[: -len(ending)], ending, cells
        return None

    def verb_person(self, ws: list[Word], text: str) -> Iterator[Edit]:
        p = self.pack
        found = [i for i, w in enumerate(ws) if w.text in p.subjects or w.text in p.ambiguous_subjects]
        noun = None
        if len(found) > 1:
            return
        if found and ws[found[0]].text in p.subjects:
            at, person = found[0], p.subjects[ws[found[0]].text]
        else:
            stripped = [(i, self.lookup(w.text)) for i, w in enumerate(ws)]
            nouns = [i for i, l in stripped if l.known and any(ws[i].text.endswith(c) and c in l.stripped for c in p.classifiers)]
            if len(nouns) != 1:
                return
            at, person, noun = nouns[0], "third", ws[nouns[0]].text
        clause: list[Word] = []
        for k in range(at + 1, len(ws)):
            gap = text[ws[k - 1].end : ws[k].start]
            if ws[k].text in p.clause_breaks or re.search(f"[{MARKS}]", gap):
                break
            clause.append(ws[k])
        last = next((k for k in range(len(clause) - 1, -1, -1) if clause[k].text not in p.particles), -1)
        for k in range(last, -1, -1):
            if k and clause[k - 1].text in p.phrase_heads:
                continue
            got = self.verb(clause[k].text, k == last)
            if not got:
                continue
            root, _, cells = got
            if any(c[1] == person for c in cells) or (noun and {c[1] for c in cells} != {"honorific"}):
                return
            tense = min(t for t, _ in cells)
            ending = p.paradigms[tense].get(person)
            if ending:
                thing = noun is not None and any(noun.startswith(t) for t in p.thing_nouns)
                yield edit(clause[k], (root + ending,), "AGREEMENT" if thing else "VERB_INFLECTION", "verb_person")
            return

    def _plural_of(self, word: str) -> str | None:
        """The stem of a plural, if it has a suffix and is long enough."""
        for s in sorted(self.pack.plural_suffixes, key=lambda s: (-len(s), s)):
            if word.endswith(s) and len(word) - len(s) >= 2:
                return word[: -len(s)]
        return None

    def person_plural(self, word: str) -> str | None:
        """The stem of a word in the plural of persons."""
        s = self.pack.plural_person
        return word[: -len(s)] if s and word.endswith(s) else None

    def classifier(self, ws: list[Word]) -> Iterator[Edit]:
        p = self.pack
        kinds = [self.traits_of(w.text) for w in ws]
        at = lambda trait: [(i, ws[i]) for i, k in enumerate(kinds) if k & trait]
        for i, w in at(COUNTED):
            if w.text in p.quantifiers:
                for x in ws[i + 1 : i + 3]:
                    stem = self.plural_of(x.text)
                    if stem:
                        if stem in self.lexicon.words:
                            yield edit(x, (stem,), "CLASSIFIER", "double_plural")
                        break
        for i, w in at(SWAPPED):
            for table, heads in ((p.thing_to_person, p.person_nouns), (p.person_to_thing, p.thing_nouns)):
                if w.text in table and any(x.text in heads for x in ws[i + 1 : i + 4]):
                    # A classifier that stands by itself after the number is part of the same mistake.
                    more = ws[i + 1].text in p.bare_classifiers
                    whole = Word(w.start, ws[i + 1].end, f"{w.text} {ws[i + 1].text}") if more else w
                    yield edit(whole, (table[w.text],), "CLASSIFIER", "animacy")
                    break
        for _, w in at(PLURAL):
            if self.person_plural(w.text) in p.thing_nouns and w.text not in p.subjects:
                yield edit(w, (f"{self.person_plural(w.text)}{p.plural_suffixes[0]}",), "AGREEMENT", "animate_plural")
        for i, w in at(OWNER):
            table = p.possessives.get(w.text)
            if table is None and self.person_plural(w.text) in p.person_nouns:
                table = p.any_plural_possessive
            x = next((x for x in ws[i + 1 :] if x.text in table), None) if table else None
            if x:
                yield edit(x, (table[x.text],), "AGREEMENT", "possessive")

    def standard(self, ws: list[Word]) -> Iterator[Edit]:
        for w in ws:
            if w.text in self.pack.standard_forms:
                yield edit(w, (self.pack.standard_forms[w.text],), "NON_WORD", "standard_form")

    def labels(self, ws: list[Word]) -> list[str | None]:
        return [self.register_of(w.text, ws[i - 1].text if i else None) for i, w in enumerate(ws)]

    def register(self, ws: list[Word]) -> Iterator[Edit]:
        marks = self.labels(ws)
        archaic, modern = marks.count("archaic"), marks.count("modern")
        if archaic and modern:
            minority = "archaic" if archaic <= modern else "modern"
            for w, m in zip(ws, marks, strict=True):
                if m == minority:
                    yield edit(w, (self.counterpart(w.text, m) or "",), "GURUCHANDALI_DOSHA", "register_clash")

    def drift(self, parts: list[tuple[tuple[int, int], list[Word]]]) -> Iterator[Edit]:
        dominant: list[tuple[tuple[int, int], str]] = []
        for span, ws in parts:
            if not any(self.traits_of(w.text) & MARKED for w in ws):
                continue
            marks = self.labels(ws)
            archaic, modern = marks.count("archaic"), marks.count("modern")
            if archaic > modern:
                dominant.append((span, "archaic"))
            elif modern:
                dominant.append((span, "modern"))
        archaic = sum(d == "archaic" for _, d in dominant)
        few = min(archaic, len(dominant) - archaic)
        if len(dominant) >= 4 and few / len(dominant) >= 0.15:
            minority = "archaic" if archaic == few and archaic * 2 <= len(dominant) else "modern"
            a, b = next(span for span, d in dominant if d == minority)
            yield Edit(a, min(b, a + 1), "", (), "REGISTER_INCONSISTENCY", CONFIDENCE["register_drift"], "register_drift")

    def check(self, text: str, rules: frozenset[str] | None = None) -> list[Edit]:
        """The edits of a text in order of emission; only those of some rules, if these are given."""
        if not self.pack.lexicon:  # no table of words: marks only
            return list(punctuation(text, rules))
        asked = {d for d, own in RULES.items() if rules is None or not own.isdisjoint(rules)}
        if not asked:
            return list(punctuation(text, rules))
        out: list[Edit] = []
        parts: list[tuple[tuple[int, int], list[Word]]] = []
        calls = [0]
        pattern = self.pack.rules.tokens
        for a, b in sentences(text, self.pack.rules):
            ws = [Word(m.start(), m.end(), m.group()) for m in pattern.finditer(text, a, b)]
            traits = reduce(or_, (self.traits_of(w.text) for w in ws), 0)
            parts.append(((a, b), ws))
            # Generators: those that aren't asked for do nothing.
            each = {"spelling": self.spelling(ws, calls), "collocation": self.collocation(ws), "verb_person": self.verb_person(ws, text), "classifier": self.classifier(ws), "standard": self.standard(ws), "register": self.register(ws)}
            for name, found in each.items():
                if name in asked and (name not in TRAITS or TRAITS[name] & traits):
                    out += found
        out += punctuation(text, rules)
        if "drift" in asked:
            out += self.drift(parts)
        return out if rules is None else [e for e in out if e.rule in rules]


EDIT_FIELDS = ",".join(f"{n}:{t}" for n, t in (p.rsplit(" ", 1) for p in EDIT_DDL.split(", ")))


def as_rows(found: list[Edit]) -> list[dict]:
    return [
        {"start": e.start, "end": e.end, "original": e.original, "suggestions": list(e.suggestions), "error_class": e.error_class, "confidence": e.confidence, "stage": 1, "rule": e.rule, "seq": n}
        for n, e in enumerate(found)
    ]


def edits(docs: DataFrame, pack: Pack, id_col: str = "doc_id", text: str = "text", rules: tuple[str, ...] | None = None) -> DataFrame:
    """docs' (id, edits): an array of edits in the order of emission; only those of some rules, if these are given."""
    some = None if rules is None else frozenset(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(pack)  # once a task
        for b in batches:
            for part in of_batch(b, 1):
                found = [list(enumerate(checker.check(x or "", some))) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), edit_arrays(found, 1 << 30)], names=[id_col, "edits"])

    schema = T.StructType([docs.select(id_col).schema[0], *T._parse_datatype_string(f"edits array<struct<{EDIT_FIELDS}>>").fields])
    return docs.select(id_col, text).mapInArrow(run, schema)


def normalized_edits(docs: DataFrame, pack: Pack, text: str = "text") -> DataFrame:
    """docs with one more column, __sc_found: the normalised text, its offset map (null if no pass changed the
    text) and passes, and the edits in it. Both steps run once, in one pass over the text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        checker = Checker(pack)
        for xs in (part for b in batches for part in of_series(b)):
            rows = []
            for x in xs:
                new, places, passes = normalize(x)
                steps = [{"place": p, "origin": q, "step": s} for p, q, s in places.rows()]
                rows.append((new, x or "", steps if passes else None, passes, as_rows(checker.check(new))))
            yield pd.DataFrame(rows, columns=["text", "original", "offset_map", "applied_rules", "edits"])

    ddl = f"struct<text:string,original:string,offset_map:{OFFSETS_DDL},applied_rules:array<string>,edits:array<struct<{EDIT_FIELDS}>>>"
    return docs.withColumn("__sc_found", F.pandas_udf(run, ddl)(text))


def edit_arrays(lists: list[list[tuple[int, Edit]]], most_suggestions: int) -> pa.ListArray:
    """Edits of several texts, each with its place in order of emission, as an Arrow column."""
    flat = [x for one in lists for x in one]
    found = [e.suggestions[:most_suggestions] for _, e in flat]
    ends = lambda xs: pa.array([0, *accumulate(map(len, xs))], pa.int32())
    columns = {
        "start": pa.array([e.start for _, e in flat], pa.int32()), "end": pa.array([e.end for _, e in flat], pa.int32()), "original": pa.array([e.original for _, e in flat], pa.string()),
        "suggestions": pa.ListArray.from_arrays(ends(found), pa.array([s for one in found for s in one], pa.string())), "error_class": pa.array([e.error_class for _, e in flat], pa.string()),
        "confidence": pa.array([e.confidence for _, e in flat], pa.float64()), "stage": pa.array([1] * len(flat), pa.int32()), "rule": pa.array([e.rule for _, e in flat], pa.string()),
        "seq": pa.array([n for n, _ in flat], pa.int32()),
    }
    return pa.ListArray.from_arrays(ends(lists), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def resolved_text(checker: Checker, text: str | None, config: PipelineConfig, submitted: bool = True) -> tuple[str, list[tuple[int, Edit]], list[tuple[int, Edit]]]:
    """The normalised text, and its edits that are kept and those that aren't, each with its place in order of emission."""
    new, places, passes = normalize(text)
    both = chosen(checker.check(new), config)
    if submitted and passes:
        both = tuple([(n, replace(e, start=places[e.start], end=places[e.end])) for n, e in es] for es in both)  # type: ignore[assignment]
    return new, *both


def checked(docs: DataFrame, pack: Pack, config: PipelineConfig = PipelineConfig(), id_col: str = "doc_id", submitted: bool = True, text: str = "text") -> DataFrame:
    """(id, text, kept, suppressed): normalised, checked and resolved in one pass over the text.

    Places are those of the submitted text, and text is null; or, without `submitted`, of the normalised text,
    which comes with them."""
    kind = f"array<struct<{EDIT_FIELDS}>>"
    plain = replace(pack, detectors=(), correctors=(), readability=None)  # the checker's own detectors alone go to the executors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = Checker(plain)
        for b in (part for whole in batches for part in of_batch(whole, 1)):
            kept, other, new_texts = [], [], []
            for x in b.column(1).to_pylist():
                new, a, z = resolved_text(checker, x, config, submitted)
                kept.append(a)
                other.append(z)
                new_texts.append(None if submitted else new)
            # What wasn't kept has all its suggestions, as has what lies beyond max_edits.
            arrays = [b.column(0), pa.array(new_texts, pa.string()), edit_arrays(kept, config.max_suggestions), edit_arrays(other, 1 << 30)]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "text", "kept", "suppressed"])

    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType), *T._parse_datatype_string(f"text string, kept {kind}, suppressed {kind}").fields])
    return docs.select(id_col, text).mapInArrow(run, schema)
