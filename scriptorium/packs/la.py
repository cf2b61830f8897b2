"""Latin pack. Our own addition: it proves that packs are pluggable and runs the
language-neutral rules on corpora without Bengali. Its lexicon comes from the
corpus (plans.corpus)."""

from __future__ import annotations

from scriptorium.functions.distance import LATIN_SOUNDS
from scriptorium.functions.tokenize import LATIN
from scriptorium.packs.base import Pack

PACK = Pack(code="la", rules=LATIN, script="latin", sounds=LATIN_SOUNDS)
