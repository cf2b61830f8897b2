"""Decontamination in blocks, substrings of other sizes, WARC round trips, quality sketches, chat masks, the pipeline."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from scriptorium.llm import chat, decontaminate, quality, substrings, warc

import corpus_pipeline
from tests.llm.brute import split
from tests.llm.test_oracles import hard  # noqa: F401


def test_blocks_give_what_one_automaton_gives(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(repr, decontaminate.report(docs, bench).collect()))
    mine = decontaminate.hits(docs, bench, block_chars=2000, chunk_bytes=50_000).select("doc_id", "__sc_hits.*").collect()
    assert sorted(map(repr, mine)) == want


def test_spans_are_places_in_the_original():
    machine = decontaminate.Machine([("a", "Ünï two three")], 2)
    text = "x ÜnÏ! ünï—TWO, Ünï two\nthree."
    runs, ids = machine.scan(decontaminate.normalised(text))
    spans = decontaminate._spans(text, decontaminate.words(text), runs)
    assert [text[s["start"] : s["end"]] for s in spans] == ["Ünï two\nthree"] and ids == {"a"}


def brute_hits(text, items, size):
    """(words, hit words, items found) by comparing every window with every place."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, ids = cut(text), set(), set()
    for item_id, t in items:
        x = cut(t)
        n = min(size, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[i : i + n]:
                    hit |= set(range(k, k + n))
                    ids.add(item_id)
    return w, hit, ids


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 10])
def test_automaton_finds_every_window(size):
    """Few different words, so that windows, pieces and short items overlap and repeat."""
    rng = random.Random(size)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,", "ä", "ab"]) for _ in range(n))
    for _ in range(60):
        items = [(f"i{k}", text(rng.randrange(16))) for k in range(rng.randrange(6))] + [("dup", text(size)), ("none", None)]
        items.append(("same", items[0][1]))
        machine = decontaminate.Machine(items, size)
        for _ in range(6):
            t = text(rng.randrange(40))
            if rng.random() < 0.5:
                t += " " + (rng.choice(items)[1] or "")
            w, hit, ids = brute_hits(t, items, size)
            runs, found = machine.scan(decontaminate.normalised(t))
            assert {p for a, b in runs for p in range(a, b + 1)} == hit and found == ids


def test_blocks_are_bounded(spark):
    rows = spark.createDataFrame([(k, "x" * 10) for k in range(9)] + [(9, "y" * 50), (10, None)], "item_id int, text string")
    sizes = [[len(t or "") for _, t in b] for b in decontaminate.blocks(rows, 30)]
    assert sum(map(len, sizes)) == 11 and all(sum(b) <= 30 or len([x for x in b if x]) == 1 for b in sizes)
    assert list(decontaminate.blocks(rows.limit(0), 30)) == [[]]


def brute_removed(rows, window):
    least = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "period", "flush"), [(5, 3, 50), (8, 6, 1_500_000), (13, 7, 200), (13, 2, 1)])
def test_substrings(spark, window, period, flush):
    rng = random.Random(window)
    passages = [[f"{k}.{i}" for i in range(rng.randrange(window - 2, 3 * window))] for k in range(8)]
    rows = [(None, " ".join(passages[0])), (-5, " ".join(passages[1])), (0, None), (1, "")]
    for i in range(120):
        text = []
        for _ in range(rng.randrange(4)):
            text += [rng.choice("abc") for _ in range(rng.randrange(20))] + rng.choice(passages)
        rows.append((i % 100, " ".join(text)))
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words int, kept string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.removed(df, window=window, period=period, flush=flush).collect()), key=repr)
    assert got == brute_removed(rows, window)


def test_difference_covers():
    for v in range(1, 13):
        cover = substrings.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert substrings.difference_cover(7) == (0, 1, 3)


def test_doc_bucket_is_the_same_in_both_engines(spark):
    import numpy as np

    ids = [0, 1, -1, 7, 2**40 + 3, -(2**63), 2**63 - 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(substrings.doc_bucket("id", 97)).collect()]
    assert got == substrings._doc_bucket(np.array(ids, dtype=np.int64), 97).tolist()


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.save(warc.records(pages), f"file://{tmp_path}/w")
    rows = warc.load(spark, f"file://{tmp_path}/w")
    back = {r["headers"]["X-Page-Id"]: r for r in rows.filter("record_type = 'response'").collect()}
    want = {str(r["page_id"]): r for r in pages.collect()}
    assert all(bytes(back[k]["payload"]) == want[k]["html"].encode() and back[k]["target_uri"] == want[k]["url"] for k in back)
    import gzip

    one = next((tmp_path / "w").glob("*.gz"))
    raw = gzip.decompress(one.read_bytes())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    # The same archive without the length fields, and not compressed at all.
    for name, data in (("a.warc.gz", gzip.compress(raw)), ("b.warc", raw)):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        n = warc.load(spark, str(tmp_path / name)).count()
        assert n == raw.count(b"WARC/1.1\r\n")


def test_warc_pushdown_and_skipping(spark, sf, tmp_path):
    import io

    parts = [warc.record("response", f"<{i}>", "http://a/" if i % 2 else "http://b/", None, None, {}, b"x" * 5000) for i in range(10)]
    raw = b"".join(map(warc.member, parts))
    seen = list(warc.read_records(io.BytesIO(raw), lambda h: h["WARC-Target-URI"] == "http://a/", True))
    assert len(seen) == 5 and all(p == b"x" * 5000 for _, p in seen)
    (tmp_path / "x.warc.gz").write_bytes(raw)
    df = warc.load(spark, str(tmp_path)).filter("record_id = '<3>'")
    assert [r["record_id"] for r in df.collect()] == ["<3>"]
    assert "record_id" in df._jdf.queryExecution().executedPlan().toString()
    assert warc.load(spark, str(tmp_path), payloads=False).filter("payload IS NULL").count() == 10


class Counted:
    """A file in memory that counts the bytes read from it."""

    def __init__(self, data):
        import io

        self.file, self.n = io.BytesIO(data), 0
        self.seek, self.tell = self.file.seek, self.file.tell

    def read(self, n=-1):
        out = self.file.read(n)
        self.n += len(out)
        return out


def foreign(n=40, size=300_000, seed=4):
    """Records of an archive that other software wrote: a plain gzip member each, headers in other case, payloads that hardly compress, one of them an archive."""
    import gzip

    rng = random.Random(seed)
    parts = []
    for i in range(n):
        body = rng.randbytes(size + i) if i % 7 else gzip.compress(b"WARC/1.0\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n", mtime=0) * 50
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        parts.append((f"<{i}>", body, f"WARC/1.0\r\nwarc-type: {'response' if i % 2 else 'request'}\r\nwarc-record-id: <{i}>\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    return parts


def test_foreign_archive_is_skipped_not_inflated():
    import gzip

    parts = foreign()
    members = [gzip.compress(x, 1, mtime=0) for _, _, x in parts]
    raw = b"".join(members)
    for data, alone in ((raw, True), (gzip.compress(b"".join(x for _, _, x in parts), 1, mtime=0), False), (b"".join(members[:5]) + gzip.compress(parts[5][2] + parts[6][2], 1, mtime=0) + b"".join(members[7:]), False)):
        source = warc.Source(Counted(data))
        assert list(warc.read_records(source, lambda h: False, True)) == []
        if alone:
            assert source.inflated < 2048 * len(parts) < sum(len(x) for _, _, x in parts) / 50
        found = list(warc.read_records(Counted(data), lambda h: h.find("WARC-Record-ID") in ("<7>", "<8>", "<39>"), True))
        assert [(h.find("Warc-Record-Id"), p) for h, p in found] == [(i, p) for i, p, _ in parts if i in ("<7>", "<8>", "<39>")]
        assert [h.find("WARC-Record-ID") for h, p in warc.read_records(Counted(data), lambda h: h.find("warc-type") == "response", False)] == [i for i, _, _ in parts if int(i[1:-1]) % 2]


def test_own_archive_reads_only_heads():
    raw = b"".join(warc.member(warc.record("response", f"<{i}>", "u", None, None, {}, random.Random(i).randbytes(400_000))) for i in range(20))
    stream = Counted(raw)
    assert len(list(warc.read_records(stream, lambda h: True, False))) == 20 and stream.n < len(raw) / 4


@pytest.mark.parametrize("kind", ["own", "foreign", "plain"])
def test_truncated_archives_raise(tmp_path, spark, kind):
    import gzip

    one = warc.record("response", "<1>", "u", None, None, {}, random.Random(1).randbytes(20_000))
    data = {"own": warc.member(one), "foreign": gzip.compress(one), "plain": one}[kind]
    for cut in (len(data) // 2, 40, len(data) - 40):
        for wanted in (True, False):
            with pytest.raises(ValueError, match="some.warc, member at"):
                list(warc.read_records(Counted(data + data[:cut]), lambda h: wanted, True, "some.warc"))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.read_records(Counted(b"<html>" * 10), lambda h: True, True))
    assert list(warc.read_records(Counted(b""), lambda h: True, True)) == []
    (tmp_path / "bad.warc.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="bad.warc.gz"):
        warc.load(spark, str(tmp_path)).collect()


def test_header_injection(spark, tmp_path):
    rows = warc.records(spark.createDataFrame([(1, "http://a/\r\nWARC-Type: evil", "x")], "page_id long, url string, html string"))
    warc.save(rows, str(tmp_path / "w"))
    assert [r["record_type"] for r in warc.load(spark, str(tmp_path / "w")).collect()] == ["response"]


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("en", f"s{i % 3}", "r", i % 50, 1) for i in range(600)], "lang string, source string, rule string, bucket long, n long")
    whole = quality.quartiles(rows.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))).first()
    parts = quality.merged(quality.merged(rows, "lang", "source"))
    assert quality.quartiles(parts).first() == whole and whole["q25"] == 12 and whole["q75"] == 37


def test_sketch_error_is_bounded(spark):
    v = spark.range(0, 100_000).select("id", quality.bucket(F.col("id")).alias("b"))
    assert v.filter("b > id OR (id - b) * 64 > id").count() == 0


def test_fences_follow_their_group(spark):
    """Sources of one language whose distributions differ have fences that differ; what is usual in one is rejected in the other."""
    prose = " ".join(f"word{i % 7}{i}" for i in range(40))
    code = " ".join(f"x{i} = $y[{i % 5}] & #z{i}" for i in range(20))
    long = " ".join(f"donaudampfschiff{i}" for i in range(40))
    rows = [(i, f"{prose} n{i}", "en", "prose") for i in range(400)] + [(1000 + i, f"{code} n{i}", "en", "code") for i in range(400)] + [(2000 + i, f"{long} n{i}", "de", "law") for i in range(400)]
    rows += [(5000, code, "en", "prose"), (5001, long, "en", "prose"), (5002, prose, "de", "law"), (5003, f"{code} {prose}", "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {(r["lang"], r["source"]): r for r in quality.fences(quality.sketch(quality.measured(df))).collect()}
    assert limits["en", "code"]["symbols_hi"] > 3 * limits["en", "prose"]["symbols_hi"] and 100 <= limits["en", "prose"]["symbols_hi"] < 200
    assert limits["de", "law"]["word_length_hi"] > limits["en", "prose"]["word_length_hi"] > 0
    assert limits["de", "law"]["word_length_lo"] > limits["en", "prose"]["word_length_lo"]
    kept = {r["doc_id"] for r in quality.profile(df).collect() if r["kept"]}
    assert {i for i, *_ in rows} - kept == {5000, 5001, 5002}


def test_a_group_is_drawn_to_its_language_by_weight(spark):
    """One document more or less in a group moves its fences a little, at any size."""
    common = [("en", "a", "word_length", 500 + 10 * (i % 5), 400) for i in range(5)]
    def hi(n):
        rows = spark.createDataFrame([*common, *[("en", "b", "word_length", 800 + 8 * k, n) for k in range(4)]], "lang string, source string, rule string, bucket long, n long")
        return {r["source"]: r["word_length_hi"] for r in quality.fences(rows).collect()}["b"]
    found = [hi(n) for n in (1, 24, 25, 26, 250)]
    assert found == sorted(found) and max(b - a for a, b in zip(found[1:3], found[2:4], strict=True)) < 20 and found[-1] - found[0] > 100


def test_quality_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_words", F.lit("mine"))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.profile(docs).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_chat_masks(spark, sf):
    convs = chat.conversations(spark.read.parquet(f"{sf}/conversations.parquet"))
    for r in chat.preferences(chat.stale_reply_pairs(convs)).collect():
        for side in ("chosen", "rejected"):
            for span in filter(None, r[f"{side}_mask"].split(",")):
                a, b = map(int, span.split(":"))
                assert r[side][:a].endswith("<|im_start|>assistant\n") and r[side][a:b].endswith("<|im_end|>")
    pair = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")])], "conv_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    same = chat.preferences(pair).first()
    assert same["n_shared"] == 2 and same["chosen"] == same["rejected"] == ""


def brute_pipeline(rows, bench, kept):
    """(id, ids) from rows (doc_id, text, ...) and the quality verdicts: near copies, contamination, secrets and tokens in plain Python."""
    from scriptorium.llm import bpe
    from tests.llm.brute import connected
    from tests.llm.test_jaccard import alike, shingles
    from tests.llm.test_secrets import brute
    from tokenizers import Tokenizer

    good = [r for r, k in zip(rows, kept, strict=True) if k]
    sets = [shingles(r[1]) for r in good]
    root = connected(range(len(good)), [(i, j) for i in range(len(good)) for j in range(i) if min(len(sets[i]), len(sets[j])) * 5 >= 4 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j])])
    first = {}
    for k, r in enumerate(good):
        first[root[k]] = min((r[0] is None, r[0] or 0), first.get(root[k], (True, 1 << 63)))
    library = Tokenizer.from_file(bpe.vocabulary_path())
    out = []
    for c, (none, i) in first.items():
        texts = {r[1] for k, r in enumerate(good) if root[k] == c and (r[0] is None, r[0] or 0) == (none, i)}
        done = []
        for t in texts:
            if brute_hits(t, bench, 10)[1]:
                continue
            new, at = "", 0
            for s in brute(t):
                _, a, b = s.split(":")
                if int(a) >= at:
                    new += t[at : int(a)] + "[SECRET]"
                at = max(at, int(b))
            done.append(library.encode(new + t[at:], add_special_tokens=False).ids)
        out.append((None if none else i, texts, done))
    return out


def quality_verdicts(sf_dir):
    """(doc_id, text) and the verdict by the SQL, row by row."""
    import duckdb
    from scriptorium.llm.sql import QUALITY_SQL

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    bench = c.execute(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    rows = c.execute("SELECT doc_id, text FROM documents").fetchall()
    named = {}
    for i, k in c.execute(f"SELECT doc_id, kept FROM ({QUALITY_SQL})").fetchall():
        named.setdefault(i, set()).add(k)
    assert all(len(x) == 1 for x in named.values())
    return rows, [next(iter(named[i])) for i, _ in rows], bench


def test_pipeline(spark, sf):
    """All rows, against brute force from the tables on; nothing is taken from the operators."""
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    rows, kept, bench = quality_verdicts(sf)
    want = {i: ids[0] for i, texts, ids in brute_pipeline(rows, bench, kept) if ids}
    assert got == want and len(want) > 50


def test_pipeline_on_hard_rows(spark, hard):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns: one row of each class that isn't contaminated."""
    got = corpus_pipeline.run(spark, hard).collect()
    rows, kept, bench = quality_verdicts(hard)
    left = [(r["doc_id"], list(r["ids"])) for r in got]
    for i, texts, ids in brute_pipeline(rows, bench, kept):
        if ids:
            found = [x for x in left if x[0] == i and x[1] in ids]
            assert len(found) >= 1, i
            left.remove(found[0])
    assert left == [] and len(got) > 100


def test_pipeline_on_empty_tables(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    for t in ("documents", "benchmark"):
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() == 0


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_digests_of_substrings(spark, sf):
    from scriptorium.llm.queries import op10_substring_dedup

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, g, sha256(k.encode()).hexdigest()) for i, n, g, k in brute_removed(rows, 13)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op10_substring_dedup(spark, sf).collect()} == want
