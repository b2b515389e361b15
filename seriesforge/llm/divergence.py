"""Source divergence audit: how each source of a language departs from the others and from the language.

Tasks count the terms of whole texts into (language, source, term) rows before
anything is shuffled. A language keeps the terms that enough of its documents
hold. Kept terms are dealt to chunks of about ``WIDTH`` terms by hash; a chunk
sorts its terms into an array, so a term's integer id is its place there
(``searchsorted``) and ids order as UTF-8 does. Counts become dense vectors, one
for each source, and probabilities, divergences and the ten best terms of a
chunk are array arithmetic in 64-bit integers. Sums and ranks over chunks are
DataFrame functions. No dictionary is whole anywhere: a group holds one chunk of
one language, and at most two blocks of about ``BLOCK`` sources; languages with
more sources meet block by block.

Exact: a probability takes three steps of long division by 1,000 and holds for
up to 9 * 10^15 occurrences a language; squared differences stay below 2^63.

Defined results: null texts, languages and sources count as ''; a source without
terms, or a language that keeps none, still gives its ``pair`` rows; a source
alone in its language gives none; repeated rows and null ids count as documents
of their own; values that tie rank by the item's UTF-8; an empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.llm.common import looked_up, release, slices, stored, table, texts_of, word_table

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
#: Terms of a source that are reported.
TOP = 10
#: Kept terms of a chunk, about.
WIDTH = 1024
#: Sources of a block, about.
BLOCK = 128
#: Different (language, source, term) that a task counts before it sends them on.
ENTRIES = 250_000

#: ASCII letters and everything beyond ASCII make terms.
TERMS = word_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
COUNTED = "lang string, source string, term binary, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed in each task as far as ``ENTRIES`` go."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def batch(held: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (times, docs) in held.items() for term, n in times.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for part in slices(batches, "text"):
            for key in zip(part["lang"].to_pylist(), part["source"].to_pylist(), texts_of(part["text"])):
                words = key[2].translate(TERMS).split()
                times, docs = held.setdefault(key[:2], (Counter(), Counter()))
                before = len(times)
                times.update(words)
                docs.update(set(words))
                size += len(times) - before
                if size >= ENTRIES:
                    yield batch(held)
                    held, size = {}, 0
        yield batch(held)
        release()

    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, COUNTED)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exactly."""
    below = total + 2 * terms
    if below >= 2**63 // 1000:
        raise OverflowError("more occurrences than 64-bit long division holds")
    left, out = counts + 2, np.zeros_like(counts)
    whole, left = np.divmod(left, below)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, below)
        out = out * 1000 + digits
    return whole * 10**9 + out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _chunk(key: tuple, rows: pa.Table) -> pa.Table:
    """Divergences within one chunk of a language's terms, between the sources of two blocks or of one."""
    lang, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
    is_term = pc.is_valid(rows["term"])
    head = rows.filter(pc.invert(is_term)).sort_by("source").to_pydict()
    body = rows.filter(is_term).select(["source", "term", "n", "total"]).combine_chunks()
    sources, kept, everywhere = head["source"], head["kept"][0], head["lang_n"][0]
    # The chunk's dictionary: sorted terms, whose places are their ids.
    terms = np.array(sorted(set(body["term"].to_pylist())), object)
    ids = np.searchsorted(terms, np.array(body["term"].to_pylist(), object)) if len(terms) else np.empty(0, np.int64)
    of = {s: i for i, s in enumerate(sources)}
    owner = np.array([of[s] for s in body["source"].to_pylist()], np.int64)
    counts = np.zeros((len(sources), len(terms)), np.int64)
    np.add.at(counts, (owner, ids), body["n"].to_numpy())  # a bincount of weights for each source, kept in integers
    p = np.stack([shares(c, n, kept) for c, n in zip(counts, head["source_n"])]) if len(terms) else counts
    out: list[tuple] = []
    block = np.array(head["block"])
    for i in range(len(sources)):
        others = np.flatnonzero((np.arange(len(sources)) > i) if first == second else (block != block[i]) & (block[i] == first))
        for j, value in zip(others, divergence(p[i], p[others]).sum(axis=1)):
            out += [(lang, sources[i], "pair", sources[j].encode(), int(value)), (lang, sources[j], "pair", sources[i].encode(), int(value))]
    if first == second and len(terms):
        total = np.zeros(len(terms), np.int64)
        total[ids] = body["total"].to_numpy()
        q = shares(total, everywhere, kept)
        for i, s in enumerate(sources):
            more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = divergence(p[i][more], q[more])
            best = np.lexsort((more, -value))[:TOP]
            out += [(lang, s, "term", terms[more[k]], int(value[k])) for k in best]
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], ["lang", "source", "part", "item", "value"])


def audited(docs: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Per language and source: its divergence from every other source, and the terms that it favours most."""
    # One shuffle by language and term serves the sums of the sources and those of the language.
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = W.partitionBy("lang", "term")
    summed = summed.withColumn("total", F.sum("n").over(w)).withColumn("lead", F.col("source") == F.min("source").over(w)).withColumn("docs", F.sum("docs").over(w))
    kept = stored(summed.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    spread = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.sum(F.col("lead").cast("long")).alias("leads"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).groupBy("lang", "source").agg(F.count("*").alias("rows"))
    groups = stored(groups.join(spread, ["lang", "source"], "left").na.fill(0, ["source_n", "leads"]))
    langs = groups.groupBy("lang").agg(F.sum("source_n").alias("lang_n"), F.sum("leads").alias("kept"), F.count("*").alias("sources"), F.sum("rows").alias("rows"))
    langs = stored(langs.withColumn("chunks", F.greatest(F.ceil(F.col("kept") / width), F.lit(1))).withColumn("blocks", F.ceil(F.col("sources") / block)))

    placed = F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    head = looked_up(groups.drop("rows", "leads"), langs, "lang", "rows")
    head = head.select("lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), placed, "blocks", none("binary").alias("term"), none("long").alias("n"), none("long").alias("total"), "source_n", "lang_n", "kept")
    body = looked_up(kept, langs, "lang", "rows")
    body = body.select("lang", "source", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), placed, "blocks", "term", "n", "total", *(none("long").alias(c) for c in ("source_n", "lang_n", "kept")))
    met = head.unionByName(body).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with", "blocks")
    found = met.groupBy("lang", "chunk", "low", "high").applyInArrow(_chunk, "lang string, source string, part string, item binary, value long")
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP)).withColumn("item", F.col("item").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (n.total + 2 * v.v) AS p
  FROM n JOIN v ON v.lang = n.lang JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM lt GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lt.n + 2)) // (ln.total + 2 * v) AS q FROM lt JOIN ln USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
