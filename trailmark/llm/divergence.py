"""How far apart the sources of a language are in their use of words, with exact counts.

Each source of a language gives each kept term p = 1 + floor(scale * (count + add) / (N + add * V)), where the language keeps the V terms that
stand in enough of its documents and N is the source's count over these.  Two sources differ by the sum of abs(p - q) over all kept terms.

Baseline correction over an inverted index: with zero counts a source gives every term the same p0, so a pair starts at V times
abs(p0 - q0), and only postings (a source's non-zero counts) emit what they change:

* a term of one source moves that source from its p0: the correction abs(p - q0) - abs(p0 - q0) depends on p alone, so postings of equal p
  are counted first and meet the other sources as one row each;
* a term of both sources was corrected twice, once from each side: postings that share a term emit abs(p - q) - abs(p - q0) -
  abs(p0 - q) + abs(p0 - q0).

Tasks count words of their own rows and hand on sums, so a frequent word or a large source is a row a task; postings of one term are at
most one a source.  The result has a row for each ordered pair of a language's sources: with that the work's largest part grows.

Null text, lang and source are ''.  Sources without kept terms take part with zero counts; a language that keeps no term has pairs of value 0,
and one of a single source has no pairs.  An empty table gives no rows; repeated rows count again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, release, written

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Distinct (lang, source, term) that a task holds before it hands its sums on, and characters from which a text's terms aren't listed at once.
HELD = 1 << 18
LONG = 1 << 20
_COUNTS = "lang string, source string, term string, n long, docs long"


class _Tally:
    """Occurrences and documents of each term of each (lang, source)."""

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, lang: str, source: str, text: str) -> int:
        """How many terms the group has now more than before."""
        n, docs = self.of.setdefault((lang, source), (Counter(), Counter()))
        before = len(n)
        text = text.encode().lower().decode()  # of bytes, only A-Z
        if len(text) < LONG:
            words = _TERM.findall(text)
            n.update(words)
            docs.update(set(words))
        else:
            own = Counter(m.group() for m in _TERM.finditer(text))
            n.update(own)
            docs.update(own.keys())
        return len(n) - before

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        """A row for each term, and one without a term for each group."""
        for (lang, source), (n, docs) in self.of.items():
            k = len(n) + 1
            columns = [pa.array([lang]).take(pa.array([0] * k)), pa.array([source]).take(pa.array([0] * k)), pa.array([None, *n], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])
        self.of = {}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, held = _Tally(), 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text")), strict=True):
            held += tally.add(lang.as_py(), source.as_py(), text.as_py())
            if held > HELD:
                yield from tally.handed_on()
                held = 0
    yield from tally.handed_on()
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: a row for each term of each (lang, source), and one of null term for each of these."""
    texts = pick(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column | str, size: str, terms: str, add: int, scale: int) -> Column:
    """1 + floor(scale * (n + add) / (size + add * terms)), exactly; null where there are no terms."""
    whole = (F.lit(scale).cast("decimal(18,0)") * (F.col(n) + add).cast("decimal(20,0)")).alias("a")
    parts = (F.col(size) + add * F.col(terms)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, F.when(F.col(terms) > 0, parts))


def divergence(docs: DataFrame, least_docs: int = 30, add: int = 5, scale: int = 1_000_000_000, most_terms: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (other source, or term), value, rank (from 1 per lang, source and part).

    Part 'pair' lists every other source of the language, by the sum of abs(p - q); part 'term' the ``most_terms`` kept terms that the
    source uses beyond the whole language's share, by that excess.  Ties go to the smaller item."""
    counts = written(term_counts(docs), "terms")
    of_term = Window.partitionBy("lang", "term")
    seen = counts.where("term IS NOT NULL").select("*", F.sum("docs").over(of_term).alias("all_docs"), F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).cast("long").alias("once"))
    kept = written(seen.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "once"), "kept")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("once").alias("terms"), F.sum("n").alias("lang_size"))
    groups = counts.where("term IS NULL").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("size"), zero("terms"), zero("lang_size"))
    groups = written(groups.withColumn("none", F.lit(0)).withColumn("p0", _share("none", "size", "terms", add, scale)).drop("none"), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", _share("n", "size", "terms", add, scale).alias("p"), _share("lang_n", "lang_size", "terms", add, scale).alias("q"))
    shares = written(shares, "shares")

    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"), "terms")
    one = groups.select("lang", F.col("source").alias("a"), "p0")
    start = one.join(other, "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * apart("p0", "q0"), F.lit(0)).alias("value"))
    equal = shares.groupBy("lang", F.col("source").alias("a"), "p0", "p").agg(F.count("*").alias("times"))
    alone = equal.join(other, "lang").where("a <> b").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("times") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    left = shares.select("lang", "term", F.col("source").alias("a"), "p0", "p")
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p0").alias("q0"), F.col("p").alias("p_b"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (apart("p", "p_b") - apart("p", "q0") - apart("p0", "p_b") + apart("p0", "q0")).alias("value"))
    summed = written(start.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    pairs = summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(summed.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= most_terms))
