"""Secret scans: patterns, and password guess cost of credential-context values.

Patterns give the base spans: assignments to a credential name, access key ids
and long hexadecimal runs. Besides, every value in a credential context is costed:
that of an assignment found by the pattern, what follows a wider set of credential
names (`pwd: ...`, `passphrase is ...`; a name may stand within a longer one, as in
DB_PASSWORD, PGPASSWORD or aws_secret_access_key), `user:value@host` in an address,
and `bearer ...`. The value is cut into words, dates, repeats, keyboard walks and
brute-force spans so that the sum of the guesses' logarithms is least. The cost of
that cut, in powers of ten, says how hard the value is to guess, and decides: a value
that costs `min_cost` or more is a span of kind `guess`, whether or not a pattern
found it; a placeholder or a plain word is not.

Words are ranked: first those that guessers try, then the whole words of two
installed tokenizer vocabularies, commonest first, so a word is plain if it is one
of theirs or made of two. Long words of languages that these vocabularies have
only in pieces cost brute force, as random letters do.

The cut is a dynamic program from left to right over these spans: brute force; words
(three letters at least; other case and look-alike signs cost more); dates and years;
repeats of a character and keyboard walks, of three at least, that begin where their
run does or up to REACH places on; and repeats of a group of 2 to REACH characters
that isn't itself a repeat, all its whole copies taken. So each end has a bounded
number of starts, and time is in proportion to the length of values; a character
is costed once however many names precede it.

Defined results: a null or empty text has no spans; kinds are matched apart from
each other, so that spans of different kinds can overlap; a value within one that
was costed isn't costed again; offsets are code points; a table without rows gives
none; equal rows each get their row; other columns are kept, or ignored by `report`.
"""

from __future__ import annotations

import math
import re
from base64 import b64decode
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Any text without these, in lower case, has no credential context.
HINTS = ("pass", "secret", "token", "api", "pwd", "key", "credential", "auth", "bearer", "login", "://")
#: A credential name, the rest of the name it stands in, and what lies between name and value.
NAME = re.compile(r"(?ai:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|(?:access|private|client)[_-]?(?:key|secret|token)|credentials?|auth(?:orization)?|login)")
REST = re.compile(r"[A-Za-z0-9_-]*")
BETWEEN = re.compile(r"""["']?(?:[ \t]*(?:=>|:=|[:=])[ \t]*|[ \t]+is[ \t]+)["'`]?(?ai:(?:bearer|basic)[ \t]+)?""")
VALUE = re.compile(r"""[^\s"'`<>,;]+""")
OTHERS = (
    re.compile(r"""(?ai:\bbearer)\x20+([A-Za-z0-9+/_.=~-]+)"""),
    re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@"'<>]+:([^\s/@"'<>]+)@"""),
)
#: Vocabularies whose whole words are known: English, and several languages.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
# Words that guessers try first, commonest first.
WORDS = (
    "password passwd pass secret admin root user login letmein welcome qwerty monkey dragon master shadow sunshine princess football baseball "
    "superman batman iloveyou trustno test testing example sample demo changeme change default guest public private access system server "
    "service account money love hello summer winter spring autumn january february march april june july august september october november "
    "december monday friday sunday company office home house family freedom whatever computer internet database manager super power magic "
    "black white orange yellow purple silver golden green blue red the and for you your this that with from have none null true false token "
    "value string key api your-api-key placeholder dummy fake foo bar baz temp"
).split()
# Rows of keys.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
DATES = tuple(
    re.compile(f"(?=({x}))")
    for x in (r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d", r"(?:19|20)\d\d")
)
#: Places after the beginning of a run at which a repeat or a walk may start, and the longest group that repeats.
REACH = 32
_PARTS = [[q for q in range(1, p // 2 + 1) if p % q == 0] for p in range(1, REACH + 1)]
_LEET = str.maketrans("@401357$!", "aaoiestsi")


def vocabulary() -> dict[str, int]:
    """The whole words (a piece that begins with a blank, letters only, four at least) of the files in lower case, by rank."""
    import public_tokenizers

    ranks: dict[str, int] = {}
    for name in VOCABULARIES:
        at = 0
        for line in Path(public_tokenizers.path(name)).read_bytes().splitlines():
            piece = b64decode(line.split()[0]).decode("utf-8", "ignore")
            if len(piece) > 4 and piece[0] == " " and piece[1:].isalpha():
                at += 1
                word = piece[1:].lower()
                ranks[word] = min(at, ranks.get(word, at))
    return ranks


_RANK = {w: n + len(WORDS) for w, n in vocabulary().items()} | {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, _RANK))
_NEXT = {a + b for row in ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:], strict=False)}
#: What a change of span costs, so that many short spans don't undercut one.
_JOIN = math.log10(2)


def _class_size(c: str) -> int:
    return 10 if c.isdigit() and c.isascii() else 26 if c.isascii() and c.islower() else 26 if c.isascii() and c.isupper() else 33 if c.isascii() else 200


def cut(value: str, words: dict[str, int] | None = None, enough: float = math.inf) -> tuple[float, list[tuple[int, int, str]]]:
    """The least cost of value in powers of ten, and the spans that give it.

    Once no cut can cost less than enough, the search ends with enough and no spans."""
    rank = _RANK if words is None else words
    longest = _LONGEST if words is None else max(map(len, words), default=0)
    log = math.log10
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    disguised = plain != low  # compared once: at every place it would take the length of the value
    inf = math.inf
    best: list[float] = [0.0] + [inf] * n  # cost of the first i characters
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    brute, brute_from = inf, 0  # the least cost of a prefix that ends in an open brute-force span
    dates: dict[int, list[int]] = {}
    for pattern in DATES:
        for m in pattern.finditer(value):
            dates.setdefault(m.end(1), []).append(m.start())
    run = walk = 0  # where the repeat and the walk that go on begin
    same = [0] * (REACH + 1)  # characters before here that equal the one so many places back
    units: dict[str, float] = {}
    for i in range(n):
        if i % REACH == REACH - 1 and i >= 2 * REACH and brute >= enough:
            # Every place at which a later span can start: the last ones, and where runs and groups that go on may begin.
            open_ = [best[max(0, i - max(longest, REACH)) : i + 1], best[run : run + REACH + 1], best[walk : walk + REACH + 1]]
            open_ += [best[i - same[p] - p : i - same[p] + 1] for p in range(1, REACH + 1) if same[p]]
            if min(map(min, open_)) >= enough:
                return enough, []
        if i and value[i] != value[i - 1]:
            run = i
        if i and low[i - 1] + low[i] not in _NEXT:
            walk = i
        end, found = i + 1, []
        size_i = _class_size(value[i])
        opened = best[i] + (_JOIN if i else 0.0)
        if opened < brute:
            brute, brute_from = opened, i
        brute += log(size_i)
        found.append((brute, brute_from, "brute"))
        for size in range(3, min(longest, end) + 1):
            s = end - size
            got, extra = rank.get(low[s:end]), 0.0
            if got is None and disguised:
                got, extra = rank.get(plain[s:end]), log(4)
            if got is not None:
                part = value[s:end]
                cased = 0.0 if part == low[s:end] else log(2) if part[1:] == low[s + 1 : end] or part.isupper() else 0.3 * size
                found.append((best[s] + log(got + 1) + extra + cased + (_JOIN if s else 0.0), s, "word"))
        for s in dates.get(end, ()):
            found.append((best[s] + log(365 * 60 if end - s > 4 else 60) + (_JOIN if s else 0.0), s, "date"))
        for s in range(run, min(run + REACH, end - 3) + 1):
            found.append((best[s] + log(size_i * (end - s)) + (_JOIN if s else 0.0), s, "repeat"))
        for s in range(walk, min(walk + REACH, end - 3) + 1):
            found.append((best[s] + log(94 * 2 * (end - s)) + (_JOIN if s else 0.0), s, "walk"))
        for p in range(1, min(REACH, i) + 1):
            if value[i] != value[i - p]:
                same[p] = 0
                continue
            same[p] += 1
            if p > 1 and same[p] >= p and not any(same[q] >= p - q for q in _PARTS[p - 1]):
                copies = (same[p] + p) // p
                s, unit = end - copies * p, value[end - p : end]
                if unit not in units:
                    units[unit] = cut(unit, words)[0]
                found.append((best[s] + units[unit] + log(copies) + (_JOIN if s else 0.0), s, "group"))
        cost, s, kind = min(found)
        best[end], back[end] = cost, (s, kind)
    spans, end = [], n
    while end:
        s, kind = back[end]
        spans.append((s, end, kind))
        end = s
    return best[n], spans[::-1]


def guess_cost(value: str, words: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """The least cost of value, or enough if it is no less."""
    return min(enough, cut(value, words, enough)[0])


def _plain(value: str) -> bool:
    """Values that stand for another: $NAME, ${NAME}, {{name}}, <name>, ***."""
    return bool(re.fullmatch(r"\$\w+|\$?\{.*|%\w+%|[*.xX#_-]+", value))


def base(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(h in low for h in ("passw", "secret", "token", "api")):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def values(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans of values in a credential context, those of found assignments included, none within another."""
    out = []
    rest = None  # the value of the name that the last credential name stands in
    end = till = -1
    for m in NAME.finditer(text):
        at = m.end()
        if at > end:
            end = REST.match(text, at).end()
            between = BETWEEN.match(text, end)
            rest = VALUE.match(text, between.end()) if between and between.end() >= till else None
        if rest and (at == end or text[at] in "_-0123456789" or (text[at].isupper() and text[at + 1].islower())):
            out.append(rest.span())
            rest, till = None, rest.end()
    for pattern in OTHERS:
        out += [m.span(1) for m in pattern.finditer(text)]
    out += [ASSIGN.match(text, a).span(2) for kind, a, _ in found if kind == "assign"]
    kept, done = [], 0
    for a, b in sorted(set(out), key=lambda x: (x[0], -x[1])):
        if b > done:
            done = b
            while b > a and text[b - 1] in ".)]}!?:":
                b -= 1
            kept.append((a, b))
    return kept


def secrets(text: str | None, min_cost: float = 10.0, min_chars: int = 6) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind."""
    text = text or ""
    out = base(text)
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("guess", a, b) for a, b in values(text, out) if b - a >= min_chars and not _plain(text[a:b]) and guess_cost(text[a:b], enough=min_cost) >= min_cost]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def spans(docs: DataFrame, text: str = "text", drop_text: bool = False, min_cost: float = 10.0) -> DataFrame:
    """docs with one more column, __sc_spans."""
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in secrets(x, min_cost)] for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(rows, _SPAN)], names=[*names, "__sc_spans"])

    schema = T.StructType([*fields, T.StructField("__sc_spans", T.ArrayType(T.StructType.fromDDL("kind string, start int, end int")))])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", min_cost: float = 10.0) -> DataFrame:
    """(id, spans): one row per document."""
    return spans(docs.select(id_col, "text"), drop_text=True, min_cost=min_cost).withColumnRenamed("__sc_spans", "spans")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", min_cost: float = 10.0) -> DataFrame:
    """docs with every span in text replaced by mark; spans that overlap become one."""
    schema = docs.schema
    at = docs.columns.index(text)

    def clear(x: str | None) -> str | None:
        if x is None:
            return None
        out, done = [], 0
        for _, s, e in secrets(x, min_cost):
            if s >= done:
                out += [x[done:s], mark]
            done = max(done, e)
        return "".join([*out, x[done:]]) if out else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([clear(x) for x in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, schema)


def joined(kinds: tuple[str, ...]):
    """Column: kind:start:end of the spans of these kinds, comma-joined."""
    some = F.filter(F.col("spans"), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(kind: str):
    return F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind)).cast("long")
