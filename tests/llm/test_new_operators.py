"""Source divergence, line deduplication and importance resampling: brute force, SQL, edge cases, hot keys."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import common, divergence, exact_dedup, line_dedup, near_dedup, quality, resampling
from tests.oracle import rows_of, connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, term string, rank int"
ODD = [None, "", " \n\t", "%%% ###", "word " * 30_000, "é́ ퟿ 😀 ß ſ K", "0" * 5_000, "\n\n\n", "A\x00B a\x7fb"]


def documents(spark, rows):
    """(doc_id, text, lang, source) with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DOCS)


def invented(seed, n, sources=("s1", "s2", "s3", None), langs=("en", "de", None)):
    rnd = random.Random(seed)
    words = [w + rnd.choice(["", "é", "X"]) for w in ("a b c dd Ee fff ggg hh iij zz").split()]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60))), rnd.choice(langs), rnd.choice(sources)) for i in range(n)]
    return rows + [(n + i, t, rnd.choice(langs), rnd.choice(sources)) for i, t in enumerate(ODD)] + [(None, "a b c", "en", "s1"), (0, rows[0][1], "en", "s1")]


def same_as_sql(tmp_path, docs, out, sql, benchmark=None):
    """The rows equal those of the SQL over the same documents."""
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = connected("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    if benchmark is not None:
        benchmark.coalesce(1).write.parquet(str(tmp_path / "b"))
        con.execute(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM '{tmp_path}/b/*.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(out.columns)
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(names, got.fetchall())


# 11: source divergence

def brute_divergence(rows, least=10, top=10):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        sources = [s for a, s in groups if a == lang]

        def p(count):
            n = sum(count[t] for t in kept)
            return [1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept]

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        ps = {s: p(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((sum(map(f, ps[s], ps[o])), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted(((f(a, b), t) for t, a, b in zip(kept, ps[s], whole) if counts[lang, s][t] and a > b), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("width", "block"), [(1024, 128), (4, 128), (3, 1), (5, 2)])
def test_divergence_equals_brute_force(spark, width, block):
    rows = invented(1, 400)
    got = divergence.audited(documents(spark, rows), width, block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows)


def test_divergence_equals_sql(spark, tmp_path):
    docs = documents(spark, invented(2, 300))
    same_as_sql(tmp_path, docs, divergence.audited(docs), divergence.ORACLE)


def test_divergence_sends_counts_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = invented(3, 60)
    assert sorted(map(tuple, divergence.audited(documents(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audited(documents(spark, invented(1, 1)).limit(0)).count() == 0
    alone = divergence.audited(documents(spark, [(1, None, None, None)]))
    assert alone.count() == 0
    two = divergence.audited(documents(spark, [(1, None, "x", "a"), (2, "few words", "x", "b")])).collect()
    assert sorted((r.source, r.part, r["item"], r.value, r["rank"]) for r in two) == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**15 - 7, 8 * 10**15])
    total = int(counts.sum())
    assert divergence.shares(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]
    with pytest.raises(OverflowError):
        divergence.shares(counts, 2**62, 4)


# 12: line deduplication

def brute_lines(rows):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    held = defaultdict(list)
    for d, t in rows:
        for k in {low(strip(x)) for x in (t or "").split("\n")}:
            held[k].append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for x in lines:
            k = low(strip(x))
            least = None if all(i is None for i in held[k]) else max(i for i in held[k] if i is not None)
            if len(k) < 20 or len(held[k]) < 3 or d == least:
                stay.append(x)
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(map(repr, out))


def lined(seed, n):
    rnd = random.Random(seed)
    common_lines = ["Copyright by nobody in Particular 2020", " copyright by NOBODY in particular 2020\t", "short line", "é" * 19, "é" * 20, "ÉÉ" * 10, "x" * 20, "x" * 19, "", "\x0b" + "y" * 25 + "\r", "y" * 25, "ß" * 10 + "ab" * 4]
    rows = [(rnd.randrange(10 * n), "\n".join(rnd.choice(common_lines) if rnd.random() < 0.4 else f"line {rnd.randrange(50 * n)} of some own words" for _ in range(rnd.randrange(12)))) for _ in range(n)]
    rows = list({d: (d, t) for d, t in rows}.values())
    return rows + [(-1 - i, t) for i, t in enumerate(ODD)] + [(None, common_lines[0]), (None, None), rows[0], (rows[1][0], common_lines[0] + "\nother")]


@pytest.mark.parametrize("power", [None, 3, 8])
def test_line_dedup_equals_brute_force(spark, monkeypatch, power):
    """Also with filters that are far too small: they only suspect more."""
    if power:
        monkeypatch.setattr(line_dedup, "LEAST_POWER", power)
        monkeypatch.setattr(line_dedup, "MOST_POWER", power)
    rows = lined(4, 150)
    got = line_dedup.line_digests(documents(spark, [(d, t, None, None) for d, t in rows]).repartition(5)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_lines(rows)


def test_line_dedup_with_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = lined(5, 120)
    got = line_dedup.line_digests(documents(spark, [(d, t, None, None) for d, t in rows]).repartition(4)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_lines(rows)


def test_line_dedup_equals_sql(spark, tmp_path):
    docs = documents(spark, [(d, t, None, None) for d, t in lined(6, 100) if d is not None])
    same_as_sql(tmp_path, docs, line_dedup.line_digests(docs), line_dedup.ORACLE)


def test_line_dedup_keeps_real_texts(spark):
    docs = documents(spark, [(i, f"own text {i}\n  The Same line for all of them \nend", None, None) for i in range(5)])
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.kept_texts(docs).collect()}
    assert got == {i: (1, f"own text {i}\nend") for i in range(4)}
    assert line_dedup.line_digests(docs.limit(0)).count() == 0


def test_only_suspected_lines_go_on(spark):
    """A line of one document is known to the twice-seen filter only by chance; one of two documents always is."""
    texts = [f"a line that only document {i} holds\nshared line number {i % 500} of the corpus" for i in range(1000)]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(6)
    packed = line_dedup.twice_seen(docs.select("text"), line_dedup.power_for(2000))
    found = line_dedup._suspects(spark, docs.select(F.col("doc_id").alias("id"), "text", F.lit(0).cast("long").alias("t")), packed).select("id", F.size("found").alias("n")).collect()
    assert all(r.n >= 1 for r in found) and sum(r.n for r in found) < 1020


# Earlier operators: hot keys and repeated ids

def test_quality_learns_from_an_id_once(spark, monkeypatch):
    """However often a labelled id is repeated, the driver gets one text of it; rows without id are scored all the same."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(rows) or quality.Model(np.ones(quality.TERMS), np.zeros((quality.TERMS, 0)), np.zeros((0, 0)), np.zeros(0), 0.5))
    docs = documents(spark, [(1, f"text {i}", None, None) for i in range(50)] + [(2, "other", None, None), (None, "no id", None, None), (None, None, None, None)])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fitted(docs, labels)
    assert seen == [[("other", 0), ("text 0", 1)]]
    assert quality.scored(docs, model).where("doc_id is null").count() == 2


@pytest.mark.parametrize("run", [exact_dedup.query, near_dedup.query], ids=["exact", "near"])
def test_split_paths_of_hot_keys_give_the_same_rows(spark, monkeypatch, run):
    plain = rows_of(*(lambda df: (df.columns, [tuple(r) for r in df.collect()]))(run(spark, "/root/testdata/sf0.001")))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(near_dedup, "PARTNERS", 1)
    split = rows_of(*(lambda df: (df.columns, [tuple(r) for r in df.collect()]))(run(spark, "/root/testdata/sf0.001")))
    assert split == plain


# 13: importance resampling

def brute_resampling(rows, target, percent=25):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)

    held, aims = [features(t) for _, t in rows], [features(t)[0] for t in target]
    s, t = Counter(b for f, _ in held for b in f), Counter(b for f in aims for b in f)
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for (d, _), (f, words) in zip(rows, held):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    eligible = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[4] = i
    return sorted(repr(tuple(r[:5])) for r in out)


def prose(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "Straße", "x-y", "don't"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(n)]
    return rows + [(n + i, t) for i, t in enumerate(ODD)] + [(None, " ".join(words[:40])), rows[0]], [" ".join(rnd.choices(words[:80], k=200)) for _ in range(3)] + [None]


@pytest.mark.parametrize(("size", "run"), [(resampling.RANGE, resampling.RUN), (7, 5), (1, 1)])
def test_resampling_equals_brute_force(spark, monkeypatch, size, run):
    monkeypatch.setattr(resampling, "RANGE", size)
    monkeypatch.setattr(resampling, "RUN", run)
    monkeypatch.setattr(resampling, "PIECE", 50)
    monkeypatch.setattr(resampling.drawn, "__defaults__", (25, size))
    rows, target = prose(7, 200)
    docs = documents(spark, [(d, t, None, None) for d, t in rows]).repartition(6)
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resampled(docs, aims).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(repr, map(tuple, got))) == brute_resampling(rows, target)


def test_resampling_equals_sql(spark, tmp_path):
    rows, target = prose(8, 100)
    docs = documents(spark, [(d, t, None, None) for d, t in rows if d is not None])
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    same_as_sql(tmp_path, docs, resampling.resampled(docs, aims), resampling.ORACLE, aims)


def test_resampling_of_nothing(spark):
    aims = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resampled(documents(spark, []), aims).count() == 0
    few = resampling.resampled(documents(spark, [(1, "only few words", None, None)]), aims.limit(0)).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in few] == [(1, 5, None)]


def test_words_that_pieces_cut(monkeypatch):
    text = ("Ab c9 " * 500 + "z" * 300 + " end").encode()
    whole = sorted(resampling.buckets_of(text)[0].tolist()), resampling.buckets_of(text)[1]
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(resampling, "PIECE", size)
        found, words = resampling.buckets_of(text)
        assert (sorted(found.tolist()), words) == whole


def test_tournament_merges_runs():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randrange(50), i) for _ in range(rnd.randrange(20))) for i in range(k)]
        assert list(resampling.Tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
