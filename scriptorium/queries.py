"""Queries of the checker's operators over the shared tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.config import PipelineConfig
from scriptorium.functions import bijoy, normalize, tokenize
from scriptorium.functions.distance import homophone_column, latin_key, osa_column, soundex_column
from scriptorium.functions.identity import uuid7_millis
from scriptorium.functions.letters import DANDA, u, upper_by_letter
from scriptorium.functions.offsets import remapped
from scriptorium.functions.readability import sentence_length_variance
from scriptorium.functions.scope import out_of_scope
from scriptorium.operators import affixes, evaluate, lexicon, limits, resolve, spans, store, usage
from scriptorium.operators.detect import edits
from scriptorium.operators.upserts import UpsertLog
from scriptorium.packs.base import Collocation, Pack, get_pack
from scriptorium.plans import corpus
from scriptorium.plans.check import accept_all, check, register_table_function
from scriptorium.session import cut, scratch, table
from scriptorium.sources import event_log
from scriptorium.sources.dictionary import dictionary
from scriptorium.sources.tables import gold, nukta_lint, read_baseline, write_baseline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_EV = """
ev AS (SELECT CASE event_type WHEN 'view' THEN 'check' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'ignore' END AS type, ts::DATE AS day, ts, user_id,
  floor(value)::BIGINT AS words, json_extract_string(props, '$.k')::BIGINT AS issues FROM events WHERE event_type IN ('view', 'purchase', 'error')),
e AS (SELECT *, issues % 3 AS oos, 'C' || (issues % 12)::VARCHAR AS cls FROM ev),
d AS (SELECT day, count(*) FILTER (type = 'check') AS checks, coalesce(sum(issues) FILTER (type = 'check'), 0) AS issues, coalesce(sum(oos) FILTER (type = 'check'), 0) AS oos,
  count(*) FILTER (type = 'accept') AS acc, count(*) FILTER (type = 'ignore') AS ign, coalesce(max(words) FILTER (type = 'check'), 0) AS words FROM e GROUP BY day)"""
_SUM = """coalesce(sum(checks), 0)::BIGINT AS checks, coalesce(sum(issues), 0)::BIGINT AS issues, coalesce(sum(oos), 0)::BIGINT AS out_of_scope,
  coalesce(sum(acc), 0)::BIGINT AS accepted, coalesce(sum(ign), 0)::BIGINT AS ignored, coalesce(sum(words), 0)::BIGINT AS words,
  CASE WHEN sum(acc) + sum(ign) > 0 THEN sum(acc)::DOUBLE / (sum(acc) + sum(ign)) ELSE 0.0 END AS accept_rate"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.from_driver_events(table(spark, sf_dir, "events"))


@query(f"WITH {_EV} SELECT {_SUM} FROM d")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(usage.daily(_events(spark, sf_dir)))


@query(f"""WITH {_EV}, a AS (SELECT max(day) AS today FROM e), b AS (SELECT * FROM (VALUES ('today', 0), ('week', 6), ('month', 29)) t(bucket, back))
SELECT bucket, {_SUM} FROM b, a, d WHERE CASE WHEN bucket = 'today' THEN day = today ELSE day >= today - back END GROUP BY bucket""")
def usage_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rolling(_events(spark, sf_dir))


@query(f"""WITH {_EV}, s AS (SELECT unnest(generate_series(max(day) - 13, max(day), INTERVAL 1 DAY))::DATE AS day FROM e)
SELECT s.day, coalesce(words, 0)::BIGINT AS words, coalesce(issues, 0)::BIGINT AS issues, coalesce(acc, 0)::BIGINT AS accepted FROM s LEFT JOIN d ON d.day = s.day""")
def usage_daily_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.last_days(_events(spark, sf_dir))


@query(f"""WITH {_EV} SELECT cls AS error_class, count(*) FILTER (type = 'accept')::BIGINT AS accepted, count(*) FILTER (type = 'ignore')::BIGINT AS ignored, count(*)::BIGINT AS total
FROM e WHERE type IN ('accept', 'ignore') GROUP BY cls""")
def usage_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_class(_events(spark, sf_dir))


@query(f"WITH {_EV} SELECT count(*) AS n FROM e")
def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.total(_events(spark, sf_dir))


@query("SELECT strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def usage_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(usage.local_day(F.col("ts"), "Asia/Dhaka").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.trailing_count(table(spark, sf_dir, "events"), DAY).select("event_id", "n")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, true AS accepted, [t] AS log FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.i, len(list_filter(r.log, lambda x: x >= o.t - 86400000000)) < 5,
    CASE WHEN len(list_filter(r.log, lambda x: x >= o.t - 86400000000)) < 5 THEN list_append(list_filter(r.log, lambda x: x >= o.t - 86400000000), o.t) ELSE list_filter(r.log, lambda x: x >= o.t - 86400000000) END
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id, accepted FROM r""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five requests a day, so that the limit is met."""
    return limits.limited(table(spark, sf_dir, "events"), 5, DAY).select("event_id", "accepted")


@query("""SELECT event_id FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events WHERE event_type = 'view')
WHERE gap IS NULL OR gap >= 21600000000""")
def debounced_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours, so that some are dropped."""
    return limits.debounced(table(spark, sf_dir, "events").filter("event_type = 'view'"), 6 * 3_600_000).select("event_id")


@query("SELECT user_id AS device_id, min(ts) AS created_at, max(ts) AS last_seen_at FROM events GROUP BY 1")
def device_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_last(table(spark, sf_dir, "events"))


@query("""WITH o AS (SELECT user_id AS device_id, min(ts) AS created_at, max(ts) AS last_seen_at FROM events WHERE event_type <> 'signup' GROUP BY 1),
n AS (SELECT user_id AS device_id, min(ts) AS created_at, max(ts) AS last_seen_at FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT coalesce(o.device_id, n.device_id) AS device_id, coalesce(o.created_at, n.created_at) AS created_at, greatest(coalesce(o.last_seen_at, n.last_seen_at), coalesce(n.last_seen_at, o.last_seen_at)) AS last_seen_at
FROM o FULL JOIN n ON o.device_id = n.device_id""")
def device_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return store.upserted_devices(store.first_last(e.filter("event_type <> 'signup'")), store.first_last(e.filter("event_type = 'signup'")))


@query("""SELECT user_id::VARCHAR AS device_id, arg_max(event_type, {'t': ts, 'e': event_type}) AS last_event, min(ts) AS created_at, max(ts) AS last_seen_at FROM events GROUP BY user_id""")
def device_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a log of deltas, to which the events are added week by week, the last week twice; and what each device did last."""
    rules = (("last_event", "last by last_seen_at"), ("created_at", "min"), ("last_seen_at", "max"))
    log = UpsertLog(spark, scratch(spark, "devices"), "device_id", "device_id string, last_event string, created_at timestamp, last_seen_at timestamp", rules, ranges=4, fanout=3)
    at = F.col("ts").cast("timestamp")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("device_id"), F.col("event_type").alias("last_event"), at.alias("created_at"), at.alias("last_seen_at"), F.weekofyear("ts").alias("week"))
    weeks = sorted(r["week"] for r in events.select("week").distinct().collect())
    for week in [*weeks, *weeks[-1:]]:
        log.add(events.filter(F.col("week") == week), week)
    return log.read()


_LAT = "[A-Za-z]+(?:[''’][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*"
_WORDS = f"w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_LAT}'), lambda x: regexp_matches(x, '^[a-z]')) AS ws FROM documents)"
_FREQ = f"{_WORDS}, t AS (SELECT doc_id, unnest(ws) AS word FROM w), f AS (SELECT word, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM t GROUP BY word)"


@query(f"WITH {_FREQ} SELECT word, freq::BIGINT AS freq, docs::BIGINT AS docs FROM f")
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.token_frequency(table(spark, sf_dir, "documents"))


@query(f"WITH {_FREQ} SELECT word, freq::BIGINT AS freq FROM f WHERE docs >= 3")
def corpus_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.corpus_lexicon(table(spark, sf_dir, "documents"))


@query(f"WITH {_FREQ} SELECT word FROM f WHERE docs < 3")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = cut(lexicon.token_frequency(table(spark, sf_dir, "documents")))
    return lexicon.unknown(freq, freq.filter("docs >= 3"), distinct=True)


@query(f"WITH {_FREQ} SELECT round(least(1.0, count(*) / 150000.0), 9) AS coverage, count(*) AS size FROM f WHERE docs >= 3")
def lexicon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.corpus_lexicon(table(spark, sf_dir, "documents")).agg(F.count("*").alias("size"))
    return found.select(F.round(lexicon.coverage_factor(F.col("size")), 9).alias("coverage"), "size")


@query(f"""WITH {_FREQ}, p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
u AS (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i) AS r FROM p JOIN f ON f.word = p.word AND f.docs < 3)
SELECT doc_id, count(*)::BIGINT AS n_unknown, count(*) FILTER (r <= 25)::BIGINT AS n_within FROM u GROUP BY doc_id""")
def suggest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rare = cut(lexicon.token_frequency(docs).filter("docs < 3").select("word"))
    # A document's common words don't leave it: the filter of the rare ones stops them.
    at = corpus.occurrences(docs.withColumn("row", F.col("doc_id")), "la", among=corpus.filter_of(rare))
    rare = at.join(rare, "word", "left_semi")
    return lexicon.budgeted(rare).groupBy("doc_id").agg(F.count("*").alias("n_unknown"), F.sum(F.col("within_budget").cast("long")).alias("n_within"))


# Our own Latin affixes, as many as show every way of the analysis: nested, overlapping, and a prefix.
_AFFIXED = replace(get_pack("la"), suffixes=("s", "es", "ed", "er", "ers", "ing", "ings", "ly", "al", "ion", "tion", "ions", "ness", "e", "en"), prefixes=("un", "re", "in", "th"))
_LIST = ", ".join(f"('{s}', {n})" for n, s in enumerate(sorted(_AFFIXED.suffixes, key=lambda s: (-len(s), s))))
_HEADS = ", ".join(f"('{s}', {n})" for n, s in enumerate(sorted(_AFFIXED.prefixes, key=lambda s: (-len(s), s))))


@query(f"""WITH RECURSIVE {_FREQ}, lex AS (SELECT word FROM f WHERE docs >= 3), sx AS (SELECT * FROM (VALUES {_LIST}) t(s, n)), px AS (SELECT * FROM (VALUES {_HEADS}) t(p, n)),
rest AS (SELECT word, word AS form, CAST([] AS INTEGER[]) AS path, '' AS stripped, 0 AS depth FROM f WHERE docs < 3
  UNION ALL SELECT word, form[length(p) + 1:], [1000 + n], '', 1 FROM (SELECT word, word AS form FROM f WHERE docs < 3), px WHERE starts_with(form, p) AND length(form) > length(p) + 1
  UNION ALL SELECT word, form[:length(form) - length(s)], list_append(path, n), s || stripped, depth + 1 FROM rest, sx WHERE depth < 4 AND ends_with(form, s) AND length(form) > length(s) + 1),
hit AS (SELECT rest.word, form, stripped, row_number() OVER (PARTITION BY rest.word ORDER BY path) AS r FROM rest JOIN lex ON lex.word = form)
SELECT f.word, docs >= 3 OR form IS NOT NULL AS known, CASE WHEN docs >= 3 THEN f.word ELSE form END AS form, coalesce(stripped, '') AS stripped FROM f LEFT JOIN hit ON hit.word = f.word AND r = 1""")
def affix_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents against the words that three of them share, by suffixes up to four deep and prefixes."""
    freq = cut(lexicon.token_frequency(table(spark, sf_dir, "documents")))
    found = affixes.analysed(freq, freq.filter("docs >= 3"), _AFFIXED)
    return found.select("word", "known", "form", F.array_join("stripped", "").alias("stripped"))


_KEY = "substr(word, 1, 1) || translate(substr(word, 2), 'bfpvcgjkqsxzdtlmnraeiouhwy', '111122222222334556')"


@query(f"WITH {_FREQ} SELECT {_KEY} AS key, count(*) AS words FROM f WHERE docs >= 3 GROUP BY 1")
def phonetic_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.corpus_lexicon(table(spark, sf_dir, "documents"))
    return found.groupBy(latin_key(F.col("word")).alias("key")).agg(F.count("*").alias("words"))


@query(f"""WITH {_FREQ}, k AS (SELECT word, docs, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: word[1:i-1] || word[i+1:])))) AS x FROM f),
p AS (SELECT DISTINCT a.word, b.word AS cand FROM k a JOIN k b ON a.x = b.x WHERE a.docs < 3 AND b.docs >= 3)
SELECT word, cand FROM p WHERE damerau_levenshtein(word, cand) <= 1""")
def candidates_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = cut(lexicon.token_frequency(table(spark, sf_dir, "documents")))
    return lexicon.candidates(freq.filter("docs < 3"), freq.filter("docs >= 3").select("word", "freq"), 1).select("word", "cand")


#: Pairs that need a letter changed between two that are swapped don't count as two edits: nothing is touched twice.
_APART = """(levenshtein(word, cand) <= 2 OR len(list_filter(range(1, length(word)), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j > 0 AND word[i] = cand[j+1] AND word[i+1] = cand[j]
  AND damerau_levenshtein(word[1:i-1], cand[1:j-1]) + damerau_levenshtein(word[i+2:], cand[j+2:]) <= 1)) > 0)) > 0)"""
_ONE_LESS = "list_transform(range(1, length({w}) + 1), lambda i: {w}[1:i-1] || {w}[i+1:])"


_RANKED = f"""WITH {_FREQ}, one AS (SELECT word, docs, list_distinct(list_concat([word], {_ONE_LESS.format(w="word")})) AS l FROM f),
k AS (SELECT DISTINCT word, docs, unnest(list_concat(l, flatten(list_transform(l, lambda v: list_transform(range(1, length(v) + 1), lambda i: v[1:i-1] || v[i+1:]))))) AS x FROM one),
p AS (SELECT DISTINCT a.word, b.word AS cand FROM k a JOIN k b ON a.x = b.x WHERE a.docs < 3 AND b.docs >= 3 AND abs(length(a.word) - length(b.word)) <= 2),
d AS (SELECT p.word, cand, f.freq, damerau_levenshtein(p.word, cand) AS dist FROM p JOIN f ON f.word = cand),
r AS (SELECT word, cand, dist, row_number() OVER (PARTITION BY word ORDER BY dist, abs(length(word) - length(cand)), {_KEY} <> {_KEY.replace("word", "cand")}, freq DESC, cand) AS rank
  FROM d WHERE dist <= 1 OR (dist = 2 AND {_APART}))"""


@query(f"{_RANKED} SELECT word, rank::INTEGER AS rank, cand, dist::INTEGER AS dist FROM r WHERE rank <= 5")
def candidates_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = cut(lexicon.token_frequency(table(spark, sf_dir, "documents")))
    pool = lexicon.candidates(freq.filter("docs < 3"), freq.filter("docs >= 3").select("word", "freq"), 2)
    return lexicon.ranked(pool).select("word", "rank", "cand", "dist")


@query(f"{_RANKED} SELECT f.word, coalesce(s, '') AS suggestions FROM f LEFT JOIN (SELECT word, string_agg(cand, ',' ORDER BY rank) AS s FROM r WHERE rank <= 5 GROUP BY word) x ON x.word = f.word WHERE docs < 3")
def graph_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same five by walking the lexicon's word graph, a word at a time, for every unknown word."""
    lexicon_, rare = corpus.vocabulary(table(spark, sf_dir, "documents"))
    return corpus.suggestions(rare, lexicon_, "la").select("word", F.array_join("suggestions", ",").alias("suggestions"))


_SENTENCES = r"""p AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.?!]+[.?!"'')\]]*[ \t]*') AS ps FROM documents),
b AS (SELECT doc_id, ps, list_transform(ps, lambda x: list_transform(string_split_regex(x, '\n\n+'), lambda y: CASE WHEN regexp_matches(y, '[^\s]') THEN 1 ELSE 0 END)) AS z FROM p),
n AS (SELECT doc_id, len(ps) - 1 + list_sum(list_transform(range(1, len(ps) + 1), lambda i: list_sum(z[i]) - CASE WHEN i < len(ps) THEN z[i][-1] ELSE 0 END)) AS k FROM b)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, k::BIGINT AS n_sentences FROM n")
def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every terminator run ends a sentence, and so does a blank line after text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokenize.sentence_rows(docs, tokenize.LATIN).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_sentences"))


@query(f"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[.?!]+|\\n\\n+'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS s FROM documents),
n AS (SELECT doc_id, list_transform(s, lambda x: len(regexp_extract_all(x, '{_LAT}'))::DOUBLE) AS l FROM p)
SELECT doc_id, round(CASE WHEN len(l) < 2 THEN 0.0 ELSE list_aggregate(l, 'var_pop') END, 6) AS variance FROM n""")
def sentence_length_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "[.?!]+|\\n\\n+"), lambda p: p.rlike("[A-Za-z0-9]"))
    lengths = F.transform(parts, lambda p: F.size(tokenize.words(p)).cast("double"))
    d = table(spark, sf_dir, "documents").select("doc_id", lengths.alias("l"))
    return d.select("doc_id", F.round(sentence_length_variance(F.col("l")), 6).alias("variance"))


_UI = "CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END::BIGINT"


@query(f"SELECT doc_id, {_UI} AS n_words FROM documents")
def ui_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokenize.ui_word_count(F.col("text")).alias("n_words"))


@query(f"SELECT conv_id, turn, {_UI} AS n_words FROM conversations")
def ui_word_count_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tokenize.ui_word_count(F.col("text")).alias("n_words"))


_MARK = "[।॥,;:?!]"
_TWICE = "(?:।{2,}|॥{2,}|,{2,}|;{2,}|:{2,}|\\?{2,}|!{2,})"


def _count(pattern: str, x: str = "x") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _with_rule(docs: DataFrame, rule: str) -> DataFrame:
    """(doc_id, n): edits of a rule that the detectors give each document, before overlaps are resolved."""
    return edits(docs.select("doc_id", "text"), get_pack("la"), rules=(rule,)).select("doc_id", F.size("edits").cast("long").alias("n"))


@query(f"SELECT substr(m, 1, 1) AS mark, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_TWICE}')) AS m FROM documents) GROUP BY 1")
def punct_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits(table(spark, sf_dir, "documents"), get_pack("la"), rules=("repeated_mark",)).select(F.explode("edits").alias("e"))
    return found.groupBy(F.left("e.original", F.lit(1)).alias("mark")).agg(F.count("*").alias("n"))


def _perturbed(spark: SparkSession, sf_dir: str, old: str, new: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(old), F.lit(new)).alias("text"))


@query(f"SELECT doc_id, {_count(f'[ \\t]+{_MARK}')}::BIGINT AS n FROM (SELECT doc_id, replace(coalesce(text, ''), ', ', ' ,  ') AS x FROM documents)")
def punct_space_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_rule(_perturbed(spark, sf_dir, ", ", " ,  "), "space_before")


@query(f"SELECT doc_id, {_count(f'{_MARK}[\\x{{980}}-\\x{{9FF}}]')}::BIGINT AS n FROM (SELECT doc_id, replace(coalesce(text, ''), ', ', ',ক') AS x FROM documents)")
def punct_missing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark with a letter of the pack's script right after it."""
    return _with_rule(_perturbed(spark, sf_dir, ", ", ",ক"), "missing_space")


_INNER = "[^ \\t\\n\\r\\f\\v][ \\t]{2,}"
_SPACES = f"({_count(_INNER)} - {_count(f'{_INNER}(?:[\\n\\r\\f\\v]|$)')})"


@query(f"SELECT doc_id, {_SPACES}::BIGINT AS n FROM (SELECT doc_id, replace(coalesce(text, ''), ', ', ',   ') AS x FROM documents)")
def punct_multi_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_rule(_perturbed(spark, sf_dir, ", ", ",   "), "multiple_spaces")


@query(f"SELECT doc_id, {_count('[\\x{980}-\\x{9FF}] ?\\.(?:[ \\t\\n\\r\\f\\v]|$)')}::BIGINT AS n FROM (SELECT doc_id, replace(coalesce(text, ''), ', ', 'ক. ') AS x FROM documents)")
def punct_latin_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_rule(_perturbed(spark, sf_dir, ", ", "ক. "), "latin_period")


_BLANK = "".join(f"chr({ord(c)}) || " for c in normalize.SPACE_LIKE)[:-4]


@query(f"SELECT doc_id, sha256(translate(replace(coalesce(text, ''), ', ', ',' || chr(160) || chr(8195)), {_BLANK}, '{' ' * len(normalize.SPACE_LIKE)}')) AS folded FROM documents")
def space_like_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _perturbed(spark, sf_dir, ", ", "," + u("A0 2003"))
    return docs.select("doc_id", F.sha2(normalize.space_like_folded(F.col("text")), 256).alias("folded"))


def _plain_marks(x: str) -> str:
    return f"""replace(translate({x}, '‘’“”–—', '{"''" * 2}""--'), '…', '...')"""


@query(f"""SELECT doc_id, sha256({_plain_marks(f"replace({_plain_marks("replace(coalesce(text, ''), ', ', '… ')")}, '. ', '” ')")}) AS folded FROM documents""")
def punct_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typographic marks that are there, and those put in place of others, before and after a first fold."""
    ellipses = F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("… "))
    folded = F.replace(normalize.punctuation_folded(ellipses), F.lit(". "), F.lit("” "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize.punctuation_folded(folded), 256).alias("folded"))


#: Every edit that overlaps no better one, however many a document has.
ALL_EDITS = PipelineConfig(max_edits=1 << 30)


@query(f"""WITH t AS (SELECT coalesce(text, '') AS x FROM documents),
r AS (SELECT 'space_before' AS rule, {_count(f'[ \\t]+{_MARK}')} AS n FROM t
  UNION ALL SELECT 'repeated_mark', {_count(_TWICE)} - {_count(f'[ \\t]{_TWICE}')} FROM t
  UNION ALL SELECT 'multiple_spaces', {_SPACES} - {_count(f'{_INNER}{_MARK}')} FROM t)
SELECT 'PUNCTUATION' AS error_class, rule, sum(n)::BIGINT AS n FROM r GROUP BY rule HAVING sum(n) > 0""")
def edits_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that surface, by class and rule: a space before a mark wins over repeated marks and runs of spaces."""
    rows = check(table(spark, sf_dir, "documents"), "la", ALL_EDITS)["edits"]
    return rows.filter("surfaced").groupBy("error_class", "rule").agg(F.count("*").alias("n"))


_SOME_MARK = f"[ \\t]+{_MARK}|{_TWICE}|[^ \\t\\n\\r\\f\\v][ \\t]{{2,}}[^ \\t\\n\\r\\f\\v]"


@query(f"""SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '{_SOME_MARK}')))::BIGINT AS n_marked
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""")
def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in which an edit lies: spans of lines swept with the places of edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    ends = F.aggregate(lines, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1)) + 1 + F.length(x))))
    each = docs.select("doc_id", F.posexplode(F.arrays_zip(lines.alias("line"), ends.alias("end"))).alias("n", "l")).select("doc_id", (F.col("l.end") - F.length("l.line")).alias("start"), F.col("l.end").alias("end"))
    found = check(docs, "la", ALL_EDITS)["edits"].select("doc_id", "start", "end", "seq")
    return spans.hits(each, found, ("doc_id",)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("hit_seq").alias("n_marked"))


@query(ORACLE_SQL["edits_by_class"])
def edits_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by SQL, through the table function over the whole table."""
    register_table_function(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("__sc_documents")
    return spark.sql("SELECT error_class, rule, count(*) AS n FROM check_table(TABLE(__sc_documents), 'la', max_edits => 1000000000) WHERE surfaced GROUP BY error_class, rule")


@query(f"""WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), ', ', ' ,, '), '. ', '.   ') AS x FROM documents)
SELECT doc_id, {_count(f'[ \\t]+{_MARK}')}::BIGINT AS space_before, ({_count(_TWICE)} - {_count(f'[ \\t]{_TWICE}')})::BIGINT AS repeated_mark, ({_SPACES} - {_count(f'{_INNER}{_MARK}')})::BIGINT AS multiple_spaces FROM t""")
def edits_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check over documents with a mistake at every comma and every end of a sentence: what surfaces, by rule."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(" ,, ")), F.lit(". "), F.lit(".   ")))
    one = lambda r: F.sum((F.col("surfaced") & (F.col("rule") == r)).cast("long")).alias(r)
    found = check(docs, "la", ALL_EDITS)["edits"].groupBy("doc_id").agg(*map(one, ("space_before", "repeated_mark", "multiple_spaces")))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("space_before", "repeated_mark", "multiple_spaces")])


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_LAT}')) AS x, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_LAT}'), 1) AS i FROM documents),
r AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
g AS (SELECT doc_id, run, count(*) AS n, max(length(x)) AS l FROM r WHERE NOT regexp_matches(x, '^[0-9]') GROUP BY 1, 2)
SELECT doc_id, count(*)::BIGINT AS n_spans, sum(n)::BIGINT AS n_tokens FROM g WHERE n > 1 OR l >= 2 GROUP BY doc_id""")
def out_of_scope_bn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = out_of_scope(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("n_tokens").alias("n_tokens"))


_CASES = """c AS (SELECT d.doc_id AS id, l.quality, CASE WHEN d.n_chars < 400 THEN 0 ELSE 1 END AS guess FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
k AS (SELECT cls, count(*) FILTER (quality = cls) AS support, count(*) FILTER (quality = cls AND guess = cls) AS tp, count(*) FILTER (quality <> cls AND guess = cls) AS fp,
  count(*) FILTER (quality = cls AND guess <> cls) AS fn FROM c, (VALUES (0), (1)) v(cls) GROUP BY cls)"""


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by labels against a guess by length, as cases and edits."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    none = F.lit(None).cast("int")
    cases = j.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("error_class"), none.alias("start"), none.alias("end"))
    found = j.select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 400, "0").otherwise("1").alias("error_class"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0).alias("seq"))
    both = spark.createDataFrame([("0", True), ("1", True)], "error_class string, implemented boolean")
    return evaluate.confusion(cases, found, found.limit(0), both)


@query(f"WITH {_CASES} SELECT cls::VARCHAR AS error_class, support, tp, fp, fn FROM k")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir).select("error_class", "support", "tp", "fp", "fn")


_PRF = f"""{_CASES}, m AS (SELECT cls, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM k),
f AS (SELECT cls, p, r, CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END AS f FROM m)"""


@query(f"WITH {_PRF} SELECT cls::VARCHAR AS error_class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f05 FROM f")
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(_confusion(spark, sf_dir))
    return m.select("error_class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f05")])


@query(f"WITH {_PRF} SELECT round(avg(f), 9) AS macro_f05 FROM f")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f05(evaluate.metrics(_confusion(spark, sf_dir))).select(F.round("macro_f05", 9).alias("macro_f05"))


@query(f"WITH {_PRF} SELECT 'blocker' AS severity, 'f05_' || cls::VARCHAR AS code FROM f WHERE 0.9 - f > 0.02 + 1e-12")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(_confusion(spark, sf_dir))
    base = m.select("error_class", F.lit(0.9).alias("f05"))
    return evaluate.regressions(m, base, 0.02).select("severity", "code")


@query("""WITH o AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[round_even(0.5 * (len(v) - 1), 0)::BIGINT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::BIGINT + 1] AS p95, v[round_even(0.99 * (len(v) - 1), 0)::BIGINT + 1] AS p99 FROM o""")
def eval_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "events"), "value", (0.5, 0.95, 0.99), "event_type")


@query("""SELECT count(*) AS sentences, count(*) FILTER (regexp_matches(text, ',{2,}|;{2,}|:{2,}|\\?{2,}|!{2,}')) AS flagged,
round(count(*) FILTER (regexp_matches(text, ',{2,}|;{2,}|:{2,}|\\?{2,}|!{2,}')) / count(*)::DOUBLE, 9) AS rate FROM documents""")
def eval_clean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return evaluate.clean_rate(docs, docs.filter(F.col("text").rlike(r"([,;:?!])\1"))).withColumn("rate", F.round("rate", 9))


@query("""WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, r.lang, k::INTEGER AS pool_rank, n AS pool_size FROM r JOIN s ON s.lang = r.lang ORDER BY k, n, r.lang LIMIT 100""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 100)
    return found.select("doc_id", "lang", "pool_rank", "pool_size")


@query("""SELECT * FROM (VALUES (1, 0, 4, true), (1, 2, 6, false), (1, 6, 8, true), (1, 8, 9, false), (2, 0, 2, false), (2, 0, 3, true)) t(doc_id, "start", "end", surfaced)""")
def resolve_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, equal confidences, the gate's bound, and touching spans."""
    ddl = "doc_id int, edits array<struct<start:int,end:int,original:string,suggestions:array<string>,error_class:string,confidence:double,stage:int,rule:string,seq:int>>"
    e = lambda a, b, c, n: (a, b, "x", ["y"], "NON_WORD", c, 1, "r", n)
    rows = [(1, [e(2, 6, 0.8, 0), e(0, 4, 0.9, 1), e(6, 8, 0.55, 2), e(8, 9, 0.549, 3)]), (2, [e(0, 3, 0.9, 0), e(0, 2, 0.7, 1)])]
    found = resolve.edit_rows(resolve.resolved(spark.createDataFrame(rows, ddl), PipelineConfig()))
    return found.select("doc_id", "start", "end", "surfaced")


@query("SELECT * FROM (VALUES ('ab', 'ba', 1), ('CA', 'ABC', 3), ('abc', 'abc', 0), ('', 'ab', 2), ('kitten', 'sitting', 3)) t(a, b, d)")
def osa_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("ab", "ba"), ("CA", "ABC"), ("abc", "abc"), ("", "ab"), ("kitten", "sitting")], "a string, b string")
    return rows.withColumn("d", osa_column(F.col("a"), F.col("b"), 10))


def _bn(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "সে কারন জানে না।"), (2, "সে কারণ জানে না।"), (3, "আমি কাজ করবে।"), (4, "আমি কাজ করবো।"), (5, "তুমি ভালো , কাজ করছো।।"),
        (6, "অনেক বইগুলো ভালো।"), (7, "একটা শিক্ষক ভালো।"), (8, "বইরা ভালো।"), (9, "তারা তার কাজ করেছে।"), (10, "দিন দুঃখী মানুষ।"), (11, "বাড়ী ভালো।"),
        (12, "তাহারা কাজ করছে।"), (13, "আমি  ভাত খাই."), (14, "আমি ভালো,তুমি ভালো।"),
    ]
    return spark.createDataFrame([(i, normalize.normalize(t)[0]) for i, t in rows], "doc_id int, text string")


@query("""SELECT * FROM (VALUES (1, 'violation', 'NOTVA_SHOTVA'), (5, 'space_before', 'PUNCTUATION'), (5, 'repeated_mark', 'PUNCTUATION'), (6, 'double_plural', 'CLASSIFIER'), (7, 'animacy', 'CLASSIFIER'),
(8, 'animate_plural', 'AGREEMENT'), (9, 'possessive', 'AGREEMENT'), (10, 'collocation', 'HOMONYM'), (11, 'standard_form', 'NON_WORD'), (12, 'register_clash', 'GURUCHANDALI_DOSHA'),
(13, 'multiple_spaces', 'PUNCTUATION'), (13, 'latin_period', 'PUNCTUATION'), (14, 'missing_space', 'PUNCTUATION')) t(doc_id, rule, error_class)""")
def bn_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules fire on our own sentences, unknown words aside."""
    rows = resolve.edit_rows(resolve.resolved(edits(_bn(spark), get_pack("bn"))))
    return rows.filter("surfaced AND rule NOT LIKE 'unknown%'").select("doc_id", "rule", "error_class").distinct()


@query("SELECT * FROM (VALUES (1, 1), (2, 2)) t(doc_id, n)")
def bn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period ends nothing; a danda and a blank line do."""
    docs = spark.createDataFrame([(1, u("986 9AE 9BF") + ". " + u("9AD 9BE 9A4 964 964") + '"  '), (2, u("995 964 20 996") + "\n\n")], "doc_id int, text string")
    return tokenize.sentence_rows(docs).filter("trim(text) <> ''").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT * FROM (VALUES (1, 'compose_nukta', 1, 2), (2, 'strip_invisibles,punct_fold', 3, 4), (3, '', 2, 2)) t(doc_id, rules, n, original_end)")
def normalize_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes that fired, the new length, and where the new end lies in the submitted text."""
    docs = spark.createDataFrame([(1, u("9A1 9BC")), (2, u("200B") + "a" + u("2018") + "b"), (3, "ab")], "doc_id int, text string")
    n = docs.select("doc_id", normalize.normalized(F.col("text")).alias("norm"))
    return n.select(
        "doc_id", F.array_join("norm.applied_rules", ",").alias("rules"), F.length("norm.text").alias("n"),
        remapped(F.length("norm.text"), F.col("norm.offset_map"), F.length("norm.text")).alias("original_end"),
    )


@query("SELECT * FROM (VALUES (1, true, false), (2, false, false), (3, false, false)) t(doc_id, detected, converted)")
def bijoy_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(1, "Avgvi ‡mvbvi evsjv Avwg †Zvgvq fv‡jvevwm ‡ ‡ †"), (2, "plain words"), (3, u("986 9AE 9BF"))], "doc_id int, text string")
    return docs.select("doc_id", bijoy.report(F.col("text")).alias("r")).select("doc_id", "r.detected", (F.col("r.converted") != F.col("r.text")).alias("converted"))


@query("SELECT * FROM (VALUES (1, true, true), (2, false, false)) t(id, same_key, homophones)")
def bn_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of one sound, and two words apart."""
    rows = spark.createDataFrame([(1, u("9B6 9AC"), u("9B8 9AC")), (2, u("995 9B2"), u("9AB 9B2"))], "id int, a string, b string")
    return rows.select("id", (soundex_column(F.col("a")) == soundex_column(F.col("b"))).alias("same_key"), homophone_column(F.col("a"), F.col("b")).alias("homophones"))


@query("SELECT * FROM (VALUES (1, true, 1), (2, true, 0), (3, false, 0), (4, true, 0)) t(id, known, n_stripped)")
def bn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, u("9AC 987 99F 9BF")), (2, u("9AC 987")), (3, u("998 998 998 998")), (4, "abc")], "id int, word string")
    return lexicon.lookups(rows, get_pack("bn")).select("id", "known", F.size("stripped").alias("n_stripped"))


@query("SELECT * FROM (VALUES ('018bcfe5-6800-7000-8000-000000000000', 1700000000000)) t(id, ms)")
def uuid7_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("018bcfe5-6800-7000-8000-000000000000",)], "id string").withColumn("ms", uuid7_millis(F.col("id")))


@query("""SELECT * FROM (VALUES ('error', 'wrong_not_in_text', 'a1'), ('error', 'wrong_is_right', 'a2'), ('error', 'few_cases', 'HOMONYM'), ('error', 'duplicate_id', 'a4'),
('warning', 'non_word_is_known', 'a2'), ('warning', 'non_word_is_known', 'a3'), ('warning', 'right_is_unknown', 'a3')) t(severity, code, id)""")
def gold_lint_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a1", "teh cat", "NON_WORD", "tge", "the"), ("a2", "the cat", "NON_WORD", "cat", "cat"), ("a3", "teh dog", "NON_WORD", "teh", "thx"), ("a4", "the dig", "HOMONYM", "dig", "dog"), ("a4", "the dig", "HOMONYM", "dig", "dog")]
    cases = spark.createDataFrame(rows, "id string, text string, error_class string, wrong string, right string")
    words = spark.createDataFrame([("the",), ("teh",), ("cat",), ("dog",)], "word string")
    return evaluate.gold_lint(cases, words)


_GOLD = """(SELECT item_id::VARCHAR AS id, text, CASE item_id % 3 WHEN 0 THEN 'NON_WORD' WHEN 1 THEN 'HOMONYM' ELSE 'C' || item_id::VARCHAR END AS error_class,
  CASE WHEN item_id % 7 = 0 THEN 'zz' ELSE '' END || regexp_extract(text, '[a-z]+') AS wrong, CASE WHEN item_id % 5 = 0 THEN regexp_extract(text, '[a-z]+') ELSE regexp_extract(text, '[a-z]+ ([a-z]+)', 1) END AS "right" FROM benchmark)"""


@query(f"""WITH {_FREQ}, lex AS (SELECT word FROM f WHERE docs >= 3), c AS (SELECT * FROM {_GOLD} UNION ALL SELECT * FROM {_GOLD} WHERE id::BIGINT % 11 = 0)
SELECT 'error' AS severity, 'wrong_not_in_text' AS code, id FROM c WHERE NOT contains(text, wrong)
UNION ALL SELECT 'error', 'wrong_is_right', id FROM c WHERE wrong = "right"
UNION ALL SELECT 'error', 'few_cases', error_class FROM c GROUP BY error_class HAVING count(*) < 3
UNION ALL SELECT 'error', 'duplicate_id', id FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'warning', 'non_word_is_known', id FROM c WHERE error_class = 'NON_WORD' AND wrong IN (SELECT word FROM lex)
UNION ALL SELECT 'warning', 'right_is_unknown', id FROM c WHERE "right" IS NOT NULL AND NOT contains("right", ' ') AND "right" NOT IN (SELECT word FROM lex)""")
def gold_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases made of the benchmark's first words, some twice and some wrong, against the documents' lexicon."""
    first = F.regexp_extract("text", "[a-z]+", 0)
    i = F.col("item_id")
    cases = table(spark, sf_dir, "benchmark").select(
        i.cast("string").alias("id"), "text", F.when(i % 3 == 0, "NON_WORD").when(i % 3 == 1, "HOMONYM").otherwise(F.concat(F.lit("C"), i.cast("string"))).alias("error_class"),
        F.concat(F.when(i % 7 == 0, "zz").otherwise(""), first).alias("wrong"), F.when(i % 5 == 0, first).otherwise(F.regexp_extract("text", "[a-z]+ ([a-z]+)", 1)).alias("right"))
    return evaluate.gold_lint(cases.union(cases.filter(F.col("id").cast("long") % 11 == 0)), lexicon.corpus_lexicon(table(spark, sf_dir, "documents")))


@query("""WITH t AS (SELECT * FROM documents), n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), chr(9) || ' ', '→·')) AS shown FROM t) SELECT * FROM n""")
def shown_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.functions.scope import shown_spaces as shown

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(shown(F.coalesce("text", F.lit(""))), 256).alias("shown"))


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[.?!]+|\\n\\n+')) AS x, generate_subscripts(string_split_regex(lower(coalesce(text, '')), '[.?!]+|\\n\\n+'), 1) AS k FROM documents),
w AS (SELECT doc_id, k, unnest(regexp_extract_all(x, '{_LAT}')) AS word, generate_subscripts(regexp_extract_all(x, '{_LAT}'), 1) AS i FROM s),
n AS (SELECT doc_id, word, lag(word) OVER o AS prev, lead(word) OVER o AS next FROM w WINDOW o AS (PARTITION BY doc_id, k ORDER BY i))
SELECT doc_id, count(*) AS n FROM n WHERE word = 'the' AND (next = 'of' OR prev = 'and') GROUP BY doc_id""")
def neighbour_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocation detector on Latin text: a word by the token before or after it, within a sentence."""
    pack = Pack("the", tokenize.LATIN, lexicon=("the",), collocations=(Collocation("the", "a", before=("of",), after=("and",)),))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    found = edits(docs, pack, rules=("collocation",)).select("doc_id", F.size("edits").cast("long").alias("n"))
    return found.filter("n > 0")


@query("""SELECT * FROM (VALUES (1, 'NOTVA_SHOTVA', 'spelling', 'na and sha'), (11, 'NON_WORD', 'spelling', 'lexicon'), (13, 'PUNCTUATION', 'punctuation', 'punctuation')) t(doc_id, error_class, category, rule_reference)""")
def bn_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations hold both words and no placeholder."""
    from scriptorium.packs import bn_specs

    rows = resolve.edit_rows(resolve.resolved(edits(_bn(spark).filter("doc_id IN (1, 11, 13)"), get_pack("bn")))).filter("surfaced AND rule NOT LIKE 'unknown%'")
    out = resolve.explained(rows, spark.createDataFrame(bn_specs.rows(), bn_specs.DDL))
    good = out.filter("NOT contains(explanation_en, '{') AND NOT contains(explanation_bn, '{') AND contains(explanation_en, original)")
    return good.select("doc_id", "error_class", "category", "rule_reference").distinct()


@query("SELECT * FROM (VALUES (1, 'a, b! c'), (1, 'a, b! c'), (2, 'clean'), (NULL, 'x!')) t(doc_id, text)")
def accept_all_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first suggestion applied; rows of equal and null ids are their own."""
    docs = spark.createDataFrame([(1, "a , b!!  c"), (1, "a , b!!  c"), (2, "clean"), (None, "x!!")], "doc_id int, text string")
    return accept_all(docs, "la")


@query("""SELECT doc_id, syllables_per_word::DOUBLE AS syllables_per_word, tatsama_density::DOUBLE AS tatsama_density, sentence_length_variance::DOUBLE AS sentence_length_variance,
  mean_sentence_length::DOUBLE AS mean_sentence_length, words::DOUBLE AS words, sentences::DOUBLE AS sentences, score::DOUBLE AS score
FROM (VALUES (1, 2.0, 0.0, 0.0, 2.0, 2.0, 1.0, 100.0), (2, 0.0, 0.0, 0.0, NULL, 0.0, 0.0, 0.0), (3, 2.333, 0.333, 0.25, 1.5, 3.0, 2.0, 62.5))
  t(doc_id, syllables_per_word, tatsama_density, sentence_length_variance, mean_sentence_length, words, sentences, score)""")
def bn_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of two syllables; no words; one learned word of three in two sentences, 100 * (1 - (0.3 * 0.1333 + 0.35 * 0.7407 + 0.15 * 0.0028) / 0.8)."""
    from scriptorium.functions.readability import FIELDS, scored

    docs = spark.createDataFrame([(1, "আমি যাই।"), (2, "no words of ours."), (3, "আমি লক্ষণ। যাই।")], "doc_id int, text string")
    r = docs.select("doc_id", scored(F.col("text")).alias("r"))
    return r.select("doc_id", *[F.col(f"r.{c}") for c in FIELDS])


@query("SELECT * FROM (VALUES (1, 'SFX A Y 12'), (2, 'PFX B N 3'), (3, 'SFX A 0 x$ .')) t(id, line)")
def affix_header_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.sources.tables import affix_header_repaired

    rows = spark.createDataFrame([(1, "SFX A Y 12$"), (2, "PFX B N 3 $"), (3, "SFX A 0 x$ .")], "id int, line string")
    return rows.select("id", affix_header_repaired(F.col("line")).alias("line"))


@query("SELECT * FROM (VALUES ('a', 1), ('b', 3), ('c', 2), ('d', NULL)) t(word, freq)")
def frequency_proxy_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a list stand for frequencies; a supplement adds words without one."""
    lines = spark.createDataFrame([("# words",), ("a",), ("b",), ("",), (" c ",), ("a",)], "value string").coalesce(1)
    more = spark.createDataFrame([("b",), ("d",)], "word string")
    return lexicon.supplemented(lexicon.frequency_proxy(lexicon.word_list(lines)), more)


@query("SELECT * FROM (VALUES (0, 4, 'x'), (8, 9, 'y')) t(\"start\", \"end\", original)")
def ignore_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose class, original and first suggestion were ignored are hidden; others with the same text stay."""
    rows = spark.createDataFrame([(0, 4, "x", ["a"], "HOMONYM"), (5, 6, "x", ["b", "a"], "HOMONYM"), (8, 9, "y", [], "HOMONYM")], "start int, end int, original string, suggestions array<string>, error_class string")
    gone = spark.createDataFrame([("HOMONYM", "x", "b"), ("NON_WORD", "y", "")], "error_class string, original string, first string")
    return resolve.ignored(rows, gone).select("start", "end", "original")


@query("SELECT * FROM (VALUES (1, 'a -> b {x}'), (2, 'only a')) t(id, said)")
def template_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "")], "id int, wrong string, right string")
    return rows.select("id", resolve.rendered(F.lit("{wrong} -> {right} {x}"), {"wrong": F.col("wrong"), "right": F.col("right")}, F.lit("only {wrong}")).alias("said"))


@query("SELECT * FROM (VALUES ('blocker', 'clean_fp'), ('warning', 'gold_total'), ('blocker', 'human_verified'), ('blocker', 'f05_A')) t(severity, code)")
def gate_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = spark.createDataFrame([(0.05, 100, 90, 0.1)], "clean_rate double, gold_total int, human int, stage4_share double")
    now = spark.createDataFrame([("A", 0.5), ("B", 0.9)], "error_class string, f05 double")
    was = spark.createDataFrame([("A", 0.53), ("B", 0.92), ("GONE", 0.9)], "error_class string, f05 double")
    return evaluate.gate(head, now, was, strict=True).select("severity", "code")


@query("SELECT * FROM (VALUES ('devices', 1), ('entitlements', 1), ('streaks', 1)) t(name, bound)")
def store_upgrade_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a device that were bound to an account, a table each."""
    import datetime

    when = datetime.datetime(2024, 1, 1)
    seen = spark.createDataFrame([("d1", when, when), ("d2", when, when)], "device_id string, created_at timestamp, last_seen_at timestamp")
    tables = store.ensure_devices({n: spark.createDataFrame([], d) for n, d in store.TABLES.items()}, seen)
    tables, _ = store.upgraded(tables, "d1", "u1")
    parts = [tables[n].filter("user_id = 'u1'").agg(F.count("*").cast("int").alias("bound")).select(F.lit(n).alias("name"), "bound") for n in ("devices", "entitlements", "streaks")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT doc_id, sha256(replace(coalesce(text, ''), ', ', ',')) AS folded FROM documents")
def invisible_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _perturbed(spark, sf_dir, ", ", "," + u("200B FEFF"))
    return docs.select("doc_id", F.sha2(normalize.invisibles_stripped(F.col("text")), 256).alias("folded"))


@query("SELECT doc_id, sha256(replace(coalesce(text, ''), ', ', '0129')) AS folded FROM documents")
def digit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _perturbed(spark, sf_dir, ", ", u("9E6 9E7 9E8 9EF"))
    return docs.select("doc_id", F.sha2(normalize.digits_folded(F.col("text")), 256).alias("folded"))


@query("SELECT * FROM (VALUES (1, 0, 15, 2, 'latin'), (1, 23, 25, 1, 'latin')) t(doc_id, \"start\", \"end\", n_tokens, script)")
def scope_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number or a word of the pack ends a foreign run; one letter alone is none."""
    docs = spark.createDataFrame([(1, "hello the world".replace(" the ", " (!) ") + " 12 a " + u("995") + " ok " + u("996") + " b")], "doc_id int, text string")
    return out_of_scope(docs).select("doc_id", "start", "end", F.col("n_tokens").cast("int").alias("n_tokens"), "script")


_BN = get_pack("bn")


def _values(rows, names: str) -> str:
    """Rows of strings as an SQL table."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(f"'{x}'" for x in r) + ')' for r in rows)}) t({names}))"


_CELLS = [(t, p, e) for t, cells in _BN.paradigms.items() for p, e in cells.items() if e not in _BN.ambiguous_endings]


@query(f"""WITH s AS {_values(_BN.subjects.items(), "subject, person")}, r AS {_values([(x,) for x in _BN.roots], "root")}, c AS {_values(_CELLS, "tense, person, ending")},
a AS {_values([(t, p, e) for t, cells in _BN.paradigms.items() for p, e in cells.items()], "tense, person, ending")},
e AS (SELECT ending, min(tense) AS tense, list(person) AS persons FROM c GROUP BY ending), n AS {_values([(x,) for x in _BN.not_verbs], "word")}
SELECT subject || ' ' || root || e.ending || '।' AS text, root || a.ending AS suggestion FROM s, r, e JOIN a ON a.tense = e.tense AND a.person = s.person
WHERE NOT list_contains(persons, s.person) AND root || e.ending NOT IN (SELECT word FROM n)""")
def bn_verb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject with every root and ending: which verbs are in another person, and the right ending of the first tense."""
    texts = sorted({(f"{s} {r}{e}।",) for s in _BN.subjects for r in _BN.roots for _, _, e in _CELLS})
    docs = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id int, text string")
    found = docs.join(check(docs, "bn")["edits"].filter("rule = 'verb_person' AND surfaced"), "doc_id")
    return found.select("text", F.get("suggestions", F.lit(0)).alias("suggestion"))


_NOUNS = (*_BN.person_nouns, *_BN.thing_nouns)


@query(f"""WITH q AS {_values([(x,) for x in _BN.quantifiers], "q")}, n AS {_values([(x, str(x in _BN.person_nouns).lower()) for x in _NOUNS], "noun, person")}, p AS {_values([(x,) for x in _BN.plural_suffixes], "suffix")},
t AS {_values([*((a, b, "true") for a, b in _BN.thing_to_person.items()), *((a, b, "false") for a, b in _BN.person_to_thing.items())], "num, other, person")}, b AS {_values([(x,) for x in ("", *_BN.bare_classifiers)], "bare")}
SELECT q || ' ' || noun || suffix || '।' AS text, 'double_plural' AS rule, noun || suffix AS original, noun AS suggestion FROM q, n, p
UNION ALL SELECT num || ' ' || CASE WHEN bare = '' THEN '' ELSE bare || ' ' END || noun || '।', 'animacy', num || CASE WHEN bare = '' THEN '' ELSE ' ' || bare END, other FROM n, b, t WHERE t.person = n.person""")
def bn_classifier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantifier with every plural, and every number with every noun, with a bare classifier between or not."""
    texts = [f"{q} {n}{s}।" for q in _BN.quantifiers for n in _NOUNS for s in _BN.plural_suffixes]
    texts += [f"{num} {b + ' ' if b else ''}{n}।" for num in sorted({*_BN.thing_to_person, *_BN.person_to_thing}) for b in ("", *_BN.bare_classifiers) for n in _NOUNS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = docs.join(check(docs, "bn")["edits"].filter("rule IN ('double_plural', 'animacy') AND surfaced"), "doc_id")
    return found.select("text", "rule", "original", F.get("suggestions", F.lit(0)).alias("suggestion"))


_WRONG = [*((a, b, "violation") for a, b in _BN.violations.items()), *((a, b, "standard_form") for a, b in _BN.standard_forms.items())]


@query(f"""WITH w AS {_values(_WRONG, "wrong, suggestion, rule")}, n AS {_values([(x,) for x in _BN.thing_nouns], "noun")}, m AS {_values([(x,) for x in "।?!"], "mark")}
SELECT noun || ' ' || wrong || mark AS text, rule, suggestion, length(noun)::INTEGER + 1 AS start, (length(noun) + 1 + length(wrong))::INTEGER AS "end" FROM w, n, m""")
def bn_spelling_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed misspelling after every noun and before every end of a sentence, with its place in the submitted text."""
    texts = [f"{n} {w}{m}" for w, _, _ in _WRONG for n in _BN.thing_nouns for m in "।?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = docs.join(check(docs, "bn")["edits"].filter("rule IN ('violation', 'standard_form') AND surfaced"), "doc_id")
    return found.select("text", "rule", F.get("suggestions", F.lit(0)).alias("suggestion"), "start", "end")


_PAIRS = [(a, m) for a, m in _BN.register.items()]


@query(f"""WITH p AS {_values(_PAIRS, "archaic, modern")}, v AS {_values([(r + e,) for r in _BN.roots for e in ("চ্ছে", "েছি", "েছেন")], "verb")}
SELECT archaic || ' ' || verb || '।' AS text, archaic AS original, modern AS suggestion FROM p, v""")
def bn_register_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archaic word beside verbs of modern endings: the archaic one, in the minority or as many, is flagged."""
    texts = [f"{a} {r}{e}।" for a, _ in _PAIRS for r in _BN.roots for e in ("চ্ছে", "েছি", "েছেন")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = docs.join(edits(docs, _BN).select("doc_id", F.explode("edits").alias("e")).select("doc_id", "e.*").filter("rule = 'register_clash'"), "doc_id")
    return found.select("text", "original", F.get("suggestions", F.lit(0)).alias("suggestion"))


@query(f"""WITH n AS (SELECT unnest(range(0, 11))::INTEGER AS modern), a AS (SELECT unnest(range(0, 11))::INTEGER AS archaic)
SELECT modern, archaic, (modern > 0 AND archaic > 0 AND modern + archaic >= 4 AND least(modern, archaic) / (modern + archaic)::DOUBLE >= 0.15) AS drift FROM n, a""")
def bn_drift_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of so many modern and archaic sentences: drift from four sentences and a share of 0.15 on."""
    docs = spark.createDataFrame([(100 * m + a, "আমি কাজ করেছি। " * m + "তাহারা কাজ জানে। " * a) for m in range(11) for a in range(11)], "doc_id int, text string")
    flagged = F.exists("edits", lambda e: e["rule"] == "register_drift")
    return edits(docs, _BN).select((F.floor(F.col("doc_id") / 100)).cast("int").alias("modern"), (F.col("doc_id") % 100).cast("int").alias("archaic"), flagged.alias("drift"))


@query(f"""WITH {_FREQ}, one AS (SELECT word, docs, list_distinct(list_concat([word], {_ONE_LESS.format(w="word")})) AS l FROM f),
k AS (SELECT DISTINCT word, docs, unnest(list_concat(l, flatten(list_transform(l, lambda v: list_transform(range(1, length(v) + 1), lambda i: v[1:i-1] || v[i+1:]))))) AS x FROM one),
p AS (SELECT DISTINCT a.word, b.word AS cand FROM k a JOIN k b ON a.x = b.x WHERE a.docs < 3 AND b.docs >= 3 AND abs(length(a.word) - length(b.word)) <= 2),
d AS (SELECT word, cand, damerau_levenshtein(word, cand) AS dist FROM p), s AS (SELECT DISTINCT word FROM d WHERE dist <= 1 OR (dist = 2 AND {_APART})),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w), u AS (SELECT o.doc_id, o.word, row_number() OVER (PARTITION BY o.doc_id ORDER BY i) AS r FROM o JOIN f ON f.word = o.word AND f.docs < 3)
SELECT doc_id, count(*)::BIGINT AS n_unknown, count(*) FILTER (r <= 25 AND word IN (SELECT word FROM s))::BIGINT AS n_suggested FROM u GROUP BY doc_id""")
def corpus_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words of each document by the documents' own lexicon, and those of the first 25 that have suggestions."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = corpus.spelling(docs, "la")
    return found.select("doc_id", F.size("edits").cast("long").alias("n_unknown"), F.size(F.filter("edits", lambda e: F.size(e["suggestions"]) > 0)).cast("long").alias("n_suggested"))


# A word of Bengali for each first letter of a Latin word, written out: subjects of four persons, verbs of four, a particle,
# the end of a clause, the head of a phrase, a quantifier and two plurals, a violation and an older form; the rest are plain words.
_WORD_OF = u("986 9AE 9BF") + " বই করছে করছি ভালো এবং না মানুষ তুমি কলম করছো ভাত সে অনেক বইগুলো কলমগুলি কারন কাজ স্কুল জল " + u("9AC 9BE 9A1 9BC 9C0") + " আপনি করছেন গল্প সঙ্গে কথা"
_W = _WORD_OF.split(" ")
_PERSON = {_W[0]: 1, _W[8]: 2, _W[12]: 3, _W[21]: 4}
_VERB = {_W[3]: 1, _W[10]: 2, _W[2]: 3, _W[22]: 4}
_case = lambda x, m: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END"
_in = lambda *ks: "(" + ", ".join(f"'{k}'" for k in ks) + ")"


def _in_bengali(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents word by word, in sentences of their own; an older form is written with a separate dot."""
    of = F.array(*map(F.lit, _W))
    sents = F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "[.?!]+"), lambda s: F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0))), lambda ws: F.size(ws) > 0)
    said = F.transform(sents, lambda ws: F.concat(F.array_join(F.transform(ws, lambda w: F.element_at(of, F.ascii(w) - 96)), " "), F.lit(DANDA)))
    return docs.select("doc_id", F.array_join(said, " ").alias("text"))


@query(f"""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[.?!]+'), lambda s: regexp_extract_all(s, '[a-z]+')), lambda ws: len(ws) > 0)) AS ws,
  generate_subscripts(list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '[.?!]+'), lambda s: regexp_extract_all(s, '[a-z]+')), lambda ws: len(ws) > 0), 1) AS sent FROM documents),
s AS (SELECT doc_id, sent, list_transform(ws, lambda w: (string_split('{_WORD_OF}', ' '))[ascii(w) - 96]) AS t FROM p),
g AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i] IN {_in(*_PERSON)}) AS subj FROM s),
c AS (SELECT *, t[subj[1] + 1:] AS after FROM g),
d AS (SELECT *, CASE WHEN len(subj) = 1 THEN after[:coalesce(list_position(after, '{_W[5]}') - 1, len(after))] ELSE [] END AS clause FROM c),
e AS (SELECT *, coalesce(list_max(list_filter(range(1, len(clause) + 1), lambda i: clause[i] <> '{_W[6]}')), 0) AS last FROM d),
f AS (SELECT *, list_max(list_filter(range(1, last + 1), lambda i: clause[i] IN {_in(*_VERB)} AND NOT (i > 1 AND clause[i - 1] = '{_W[24]}'))) AS verb_at FROM e),
v AS (SELECT doc_id, sent, t, CASE WHEN verb_at IS NOT NULL AND {_case("clause[verb_at]", _VERB)} <> {_case("t[subj[1]]", _PERSON)} THEN subj[1] + verb_at END AS verb,
  list_distinct(list_filter(list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = '{_W[13]}'), lambda i: CASE WHEN t[i+1] IN {_in(_W[14], _W[15])} THEN i + 1 WHEN t[i+2] IN {_in(_W[14], _W[15])} THEN i + 2 END), lambda i: i IS NOT NULL)) AS plural FROM f),
o AS (SELECT doc_id, sent, i, t[i] AS w, coalesce(i = verb, false) AS verb, list_contains(plural, i) AS plural, length(t[i]) + CASE WHEN i = len(t) THEN 2 ELSE 1 END AS wide FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM v)),
x AS (SELECT *, sum(wide) OVER (PARTITION BY doc_id ORDER BY sent, i) - wide AS start, w = '{_W[16]}' AS violation, w = '{_W[20]}' AS older FROM o)
SELECT doc_id, count(*) FILTER (verb)::BIGINT AS n_verb, count(*) FILTER (plural)::BIGINT AS n_plural, count(*) FILTER (violation)::BIGINT AS n_violation, count(*) FILTER (older)::BIGINT AS n_older,
  coalesce(sum(start) FILTER (verb OR plural OR violation OR older), 0)::BIGINT AS starts FROM x GROUP BY doc_id""")
def bn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check over documents turned into Bengali word by word: clauses with particles and phrase heads, plurals after
    quantifiers, misspellings, and places mapped back over letters that the normaliser composes."""
    docs = _in_bengali(table(spark, sf_dir, "documents")).filter("text <> ''")
    found = check(docs, "bn", ALL_EDITS)["edits"].filter("surfaced AND rule IN ('verb_person', 'double_plural', 'violation', 'standard_form')")
    one = lambda r, n: F.sum((F.col("rule") == r).cast("long")).alias(n)
    n = found.groupBy("doc_id").agg(one("verb_person", "n_verb"), one("double_plural", "n_plural"), one("violation", "n_violation"), one("standard_form", "n_older"), F.sum("start").alias("starts"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_verb", "n_plural", "n_violation", "n_older", "starts")])


# What stands for a pair of letters in a kind of documents, and what the normaliser makes of it, by pass.
_FORMS = (("th", "khanda_ta", u("9A4 9CD 200D"), u("9CE")), ("en", "compose_nukta", u("9A1 9BC"), u("9DC")), ("on", "nfc", u("995 9C7 9BE"), u("995 9CB")), ("in", "compose_vowel_signs", u("995 9BE 9C7"), u("995 9CB")),
          ("er", "collapse_hasanta", u("995 9CD 9CD 9CD 996"), u("995 9CD 996")), ("an", "strip_stray_zwnj", u("995 200C 9CD 200C 996"), u("995 9CD 200C 996")), ("re", "strip_zwj", u("995 200D 996"), u("995 996")))


def _by_kind(at: int) -> str:
    return "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN replace(text, '{f[0]}', '{f[at]}')" for k, f in enumerate(_FORMS)) + " END"


_pass_of = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{f[1]}'" for k, f in enumerate(_FORMS)) + " END"


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS (SELECT doc_id, length({_by_kind(2)}) AS submitted, {_by_kind(3)} AS x,
  CASE WHEN {_by_kind(2)} = text THEN '' ELSE {_pass_of} END AS pass FROM t)
SELECT doc_id, sha256(x) AS text_sha256, pass, submitted::BIGINT AS original_end FROM k""")
def normalized_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with decomposed, reversed, doubled or stray letters at every place of a pair of letters, seven ways: the text
    after all passes, the pass that did it, and where the end lies in the submitted text."""
    kind = F.pmod("doc_id", F.lit(7))
    x = F.coalesce("text", F.lit(""))
    made = F.coalesce(*[F.when(kind == k, F.replace(x, F.lit(f[0]), F.lit(f[2]))) for k, f in enumerate(_FORMS)])
    n = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), normalize.normalized(made).alias("norm"))
    own = F.coalesce(*[F.when((F.col("kind") == k) & F.array_contains("norm.applied_rules", f[1]), F.lit(f[1])) for k, f in enumerate(_FORMS)], F.lit(""))
    size = F.length("norm.text")
    return n.select("doc_id", F.sha2("norm.text", 256).alias("text_sha256"), own.alias("pass"), remapped(size, F.col("norm.offset_map"), size).cast("long").alias("original_end"))


@query(f"""WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), ', ', ' ,, '), '. ', '.   ') AS x FROM documents),
n AS (SELECT doc_id, {_count(f'[ \\t]+{_MARK}')} + {_count(_TWICE)} - {_count(f'[ \\t]{_TWICE}')} + {_SPACES} - {_count(f'{_INNER}{_MARK}')} AS n FROM t)
SELECT doc_id, least(3, n)::BIGINT AS surfaced FROM n""")
def edits_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three edits of a document surface, the first by place."""
    docs = _perturbed(spark, sf_dir, ", ", " ,, ").withColumn("text", F.replace("text", F.lit(". "), F.lit(".   ")))
    found = check(docs, "la", PipelineConfig(max_edits=3))["edits"].filter("surfaced").groupBy("doc_id").agg(F.count("*").alias("surfaced"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("surfaced", F.lit(0)).cast("long").alias("surfaced"))


@query(f"WITH r AS ({ORACLE_SQL['edits_by_class']}) SELECT 'by class ' || error_class AS what, sum(n)::BIGINT AS n FROM r GROUP BY error_class UNION ALL SELECT 'by stage 1', sum(n)::BIGINT FROM r HAVING sum(n) > 0")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that surface, by class and by stage."""
    found = cut(check(table(spark, sf_dir, "documents"), "la", ALL_EDITS)["edits"])
    by_class = resolve.class_counts(found).select(F.concat(F.lit("by class "), "error_class").alias("what"), "n")
    return by_class.unionByName(resolve.stage_distribution(found).select(F.concat(F.lit("by stage "), F.col("stage").cast("string")).alias("what"), "n"))


@query("""WITH l AS (SELECT string_split(coalesce(text, ''), chr(10)) AS l FROM documents), r AS (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l)
SELECT sha256('NON_WORD' || chr(0) || i::VARCHAR || chr(0) || (i + length(line))::VARCHAR || chr(0) || line || chr(0) || upper(substr(line, 1, 1)))[:16] AS edit_id, count(*)::BIGINT AS n FROM r WHERE line <> '' GROUP BY 1""")
def edit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of edits by content: lines of documents as edits; equal ones share an id."""
    each = table(spark, sf_dir, "documents").select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "original")).filter("original <> ''")
    made = each.select(F.lit("NON_WORD").alias("error_class"), (F.col("i") + 1).alias("start"), (F.col("i") + 1 + F.length("original")).alias("end"), "original", F.array(upper_by_letter(F.substring("original", 1, 1))).alias("suggestions"))
    return resolve.with_ids(made).groupBy("edit_id").agg(F.count("*").alias("n"))


@query(ORACLE_SQL["eval_prf"])
def baseline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of classes, written as a baseline and read back."""
    path = scratch(spark, "baseline")
    write_baseline(eval_prf(spark, sf_dir), path)
    return read_baseline(spark, path).select("error_class", "precision", "recall", "f05")


@query("""SELECT item_id::VARCHAR AS id, position(word IN text) - 1 AS start, position(word IN text) - 1 + length(word) AS "end" FROM (SELECT item_id, text, string_split(text, ' ')[-1] AS word FROM benchmark)""")
def gold_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as files of a class each and read back: where the wrong word, an item's last, first stands in its text."""
    path = scratch(spark, "gold")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit("NON_WORD").alias("error_class"), F.element_at(F.split("text", " "), -1).alias("wrong"))
    items.write.json(f"{path}/errors")
    return evaluate.gold_spans(gold(spark, path)).select("id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH u AS (SELECT user_id::VARCHAR AS device_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)
SELECT device_id, 'free_unlimited' AS tier, 0 AS days, device_id = (SELECT min(device_id) FROM u) AS recoverable FROM u""")
def store_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device of the log known, entitled and with a streak, in a store that was saved and opened; one is found by its recovery hash."""
    path = scratch(spark, "store")
    seen = store.first_last(table(spark, sf_dir, "events")).withColumns({c: F.col(c).cast(k) for c, k in (("device_id", "string"), ("created_at", "timestamp"), ("last_seen_at", "timestamp"))})
    made = store.ensure_devices(store.ensure_devices(store.opened(spark, path), seen), seen)
    first = seen.agg(F.min("device_id")).first()[0]
    store.saved(spark, made | {"devices": store.attach_recovery(made["devices"], first, "digest") if first else made["devices"]}, path)
    back = store.opened(spark, path)
    found = store.device_for_recovery(back["devices"], "digest").select("device_id", F.lit(True).alias("found"))
    return back["entitlements"].join(back["streaks"], "device_id").join(found, "device_id", "left").select("device_id", "tier", "days", F.coalesce("found", F.lit(False)).alias("recoverable"))


@query("SELECT event_type, count(*)::BIGINT AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type")
def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events appended to a log as two segments, by day, and scanned again."""
    path = scratch(spark, "events")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (F.dayofmonth("ts") <= 15, F.dayofmonth("ts") > 15):
        event_log.append(events.filter(part), path)
    back = spark.read.schema(events.schema).parquet(f"{path}/segment-*")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


_AFF = ("SFX A Y 2", "SFX A 0 s [^sy]", "SFX A y ies [^aeiou]y", "SFX B N 1", "SFX B e ing e", "PFX U Y 1", "PFX U 0 un [^u]")


@query(f"""WITH {_FREQ}, l AS (SELECT word, freq % 2 = 0 AS a, freq % 3 = 0 AS b, freq % 5 = 0 AS p FROM f WHERE docs >= 3 AND regexp_matches(word, '^[a-z]+$')),
e AS (SELECT word AS form, p, true AS x FROM l UNION ALL SELECT word || 's', p, true FROM l WHERE a AND regexp_matches(word, '[^sy]$')
  UNION ALL SELECT word[:-2] || 'ies', p, true FROM l WHERE a AND regexp_matches(word, '[^aeiou]y$') UNION ALL SELECT word[:-2] || 'ing', p, false FROM l WHERE b AND length(word) > 1 AND word[-1] = 'e')
SELECT DISTINCT form AS word FROM (SELECT form FROM e UNION ALL SELECT 'un' || form FROM e WHERE p AND x AND form[1] <> 'u')""")
def dictionary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that three documents share, written as an affix dictionary with flags by their frequency, and all forms read back."""
    path = scratch(spark, "dictionary")
    flags = F.concat(*[F.when(F.col("freq") % n == 0, F.lit(f)).otherwise(F.lit("")) for n, f in ((2, "A"), (3, "B"), (5, "U"))])
    listed = lexicon.corpus_lexicon(table(spark, sf_dir, "documents")).filter(F.col("word").rlike("^[a-z]+\\z"))
    listed.select(F.concat("word", F.lit("/"), flags).alias("value")).write.text(f"{path}/dic")
    spark.createDataFrame([("\n".join(_AFF),)], "value string").coalesce(1).write.text(f"{path}/aff")
    return dictionary(spark, f"{path}/aff", f"{path}/dic")


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


@query(f"""WITH {_LINES} SELECT doc_id, sum(len(string_split(line, 'en')) - 1 + len(string_split(line, 'th')) - 1)::BIGINT AS n FROM l WHERE contains(line, 'en') OR contains(line, 'th') GROUP BY doc_id""")
def undotted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with dotted letters as two characters in place of pairs of letters: how many of these each has."""
    made = F.replace(F.replace("line", F.lit("en"), F.lit(u("9A1 9BC"))), F.lit("th"), F.lit(u("9AF 9BC")))
    return nukta_lint(_lines(spark, sf_dir).withColumn("value", made)).groupBy("doc_id").agg(F.sum("n_undotted").alias("n"))


@query(f"""WITH {_LINES}, i AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT doc_id) >= 3) SELECT doc_id, count(*)::BIGINT AS n FROM l WHERE line NOT IN (SELECT line FROM i) GROUP BY doc_id""")
def ignored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as edits without those that were ignored: lines that three documents share."""
    each = _lines(spark, sf_dir).select("doc_id", F.lit("NON_WORD").alias("error_class"), F.col("line").alias("original"), F.array(F.upper("line")).alias("suggestions"))
    shared = each.groupBy("error_class", "original").agg(F.countDistinct("doc_id").alias("n")).filter("n >= 3").select("error_class", "original", F.upper("original").alias("first"))
    return resolve.ignored(each, shared).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES} SELECT doc_id, sha256(string_agg(x, chr(10) ORDER BY x)) AS said FROM (SELECT doc_id, CASE WHEN length(line) % 2 = 0 THEN 'no word for "' || line || '", {{other}}' ELSE line || ': write new ' || line END AS x FROM l) GROUP BY doc_id""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explanation for each line; half of them have no correction and take the other template; unknown keys stay."""
    right = F.when(F.length("line") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("new "), "line"))
    said = resolve.rendered(F.lit("{wrong}: write {right}"), {"wrong": F.col("line"), "right": right}, F.lit('no word for "{wrong}", {other}'))
    return _lines(spark, sf_dir).select("doc_id", said.alias("x")).groupBy("doc_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), "\n"), 256).alias("said"))


@query("""WITH e AS (SELECT word, row_number() OVER (ORDER BY doc_id, word) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ')[1] AS word FROM documents))
SELECT word, ((SELECT count(*) FROM e) - max(place) + 1)::BIGINT AS freq FROM e GROUP BY word""")
def list_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a list of the documents' first words stand for frequencies; of repeats the last place counts."""
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.get(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0)).alias("word"))
    return lexicon.frequency_proxy(entries)
