"""A kept index of grams for exact searches of terms in chunks.

Postings are rows (gram, email_id, chunk_index): each place of a chunk's lower-cased text begins a gram of up to three characters, so a term
of three or more has all its grams in a chunk that holds it, and a shorter one begins some gram.  Rows are kept in the order of
grams, so a search reads the parts of files that its grams lie in.  Of a term's grams only the rarest is looked up; chunks that have it are
read and compared with the term itself.

Terms times chunks may be far more rows than both tables have, so pairs are made where a mail's chunks are and go nowhere from there: what is
shuffled are postings, once, the chunks' texts and the terms, which each part of the mails gets a copy of.

Changes come as generations: a batch writes the postings of its mails, and a table tells which generation of a mail counts.  ``compacted``
writes all that counts as one generation again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trailmark.sources.shared import cut
from trailmark.streaming.tables import BucketedTable

GRAM = 3
#: Grams that a scan is asked for by name; grams that are broadcast at most.
MOST_NAMED, MOST_BROADCAST = 1000, 1 << 18
#: Terms that a task keeps, and about how many postings it sorts.
MOST_TERMS, MOST_POSTINGS = 1 << 17, 1 << 19
#: Up to so many terms of one length are looked for one by one; more are looked up among the pieces of the text, at so many places at a time.
FEW, WINDOW = 128, 1 << 16
#: Terms of so many bytes at most are looked up as numbers.
CODED = 7
_TERM, _LIVE, _POSTING, _TEXT = range(4)


def grams(text: Column) -> Column:
    """The distinct grams that begin in a text; the last ones are shorter."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    at = lambda cs, i: F.coalesce(F.get(cs, i), F.lit(""))
    return F.array_distinct(F.transform(chars, lambda c, i: F.concat(c, at(chars, i + 1), at(chars, i + 2))))


def _pieces(said: bytes, n: int, asked: list[bytes]) -> set[bytes]:
    """Those of the asked terms, all n bytes long, that the text holds."""
    if len(asked) <= FEW:
        return {t for t in asked if t in said}
    found, ends = set(), len(said) - n + 1
    for at in range(0, ends, WINDOW):
        found |= {said[i : i + n] for i in range(at, min(at + WINDOW, ends))}.intersection(asked)
    return found


def _codes(said: bytes, lengths: set[int]) -> np.ndarray:
    """The pieces of a text that have one of these lengths, up to ``CODED`` bytes, as numbers that tell their lengths too; in order."""
    chars = np.frombuffer(said, np.uint8).astype(np.int64)
    code, codes = np.zeros(len(chars), np.int64), [np.zeros(0, np.int64)]
    for n in range(1, min(CODED, len(chars)) + 1):
        code = code[: len(chars) - n + 1] | chars[n - 1 :] << 8 * (n - 1)
        if n in lengths:
            codes.append(code | n << 56)
    return np.sort(np.concatenate(codes))


class _Terms:
    """Terms by the gram that tells where they may be (None: anywhere); equal ones are one, with the places of all."""

    def __init__(self, terms: list[bytes], grams: list[str | None]):
        self.number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        rows = np.array([self.number[t] for t in terms], np.int64)
        self.rows, self.many = np.argsort(rows, kind="stable"), np.bincount(rows, minlength=len(self.number))
        self.begin = np.cumsum(self.many) - self.many
        self.code = np.array([int.from_bytes(t, "little") | len(t) << 56 if len(t) <= CODED else 0 for t in self.number], np.int64)
        self.lengths = {len(t) for t in self.number if len(t) <= CODED}
        coded, self.longer = defaultdict(list), defaultdict(list)
        for t, g in dict(zip(terms, grams, strict=True)).items():
            coded[g].append(self.number[t]) if len(t) <= CODED else self.longer[g].append(t)
        self.coded = {g: np.array(x, np.int64) for g, x in coded.items()}

    def held(self, said: bytes, grams: set[str | None]) -> np.ndarray:
        """The numbers of the terms of these grams that the text holds."""
        near = np.concatenate([np.zeros(0, np.int64), *[self.coded[g] for g in grams if g in self.coded]])
        asked, hit = self.code[near], np.zeros(len(near), bool)
        for at in range(0, len(said), WINDOW) if len(near) else ():
            codes = _codes(said[at : at + WINDOW + CODED - 1], self.lengths)
            if len(codes):
                hit |= codes[np.minimum(np.searchsorted(codes, asked), len(codes) - 1)] == asked
        longer = defaultdict(list)
        for g in grams:
            for t in self.longer.get(g, ()):
                longer[len(t)].append(t)
        return np.concatenate([near[hit], np.array([self.number[t] for n, x in longer.items() for t in _pieces(said, n, x)], np.int64)])

    def rows_of(self, numbers: np.ndarray) -> np.ndarray:
        many = self.many[numbers]
        return self.rows[np.repeat(self.begin[numbers] - np.cumsum(many) + many, many) + np.arange(many.sum())]


def _meeting(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """term_id, email_id, chunk_index of each chunk that holds a term, or of the ``first`` one of each mail.

    Takes some terms, then mail by mail its generation that counts and, chunk by chunk, the chunk's postings and its text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, said, near, terms = [], [], [], None
        alive = since = key = None
        held, seen = [], None
        mails, places, found, size = [], [], [], 0

        def out(b: pa.RecordBatch) -> pa.RecordBatch:
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            columns = [pa.concat_arrays(ids).take(pa.array(np.concatenate(found)))]
            columns += [pa.array(x, b.schema.field(c).type).take(of) for x, c in ((mails, "email_id"), (places, "chunk_index"))]
            for x in (mails, places, found):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term_id", "email_id", "chunk_index"])

        for b in batches:
            kinds = b.column("kind").to_pylist()
            if _TERM in kinds:
                ids.append(b.column("term_id").slice(0, kinds.count(_TERM)))
            values = [b.column("email_id").to_numpy(zero_copy_only=False), *[b.column(c).fill_null(0).to_numpy() for c in ("chunk_index", "generation")], *[b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "body")]]
            for kind, mail, at, generation, gram, body in zip(kinds, *[v.tolist() for v in values], strict=True):
                if kind == _POSTING:
                    if mail == alive and generation == since:
                        if (mail, at) != key:
                            key, held = (mail, at), []
                        held.append(gram)
                elif kind == _TEXT and mail == alive:
                    terms = terms or _Terms(said, near)
                    has = terms.held(body, {None, *(held if (mail, at) == key else ())})
                    if first:
                        seen = np.zeros(len(terms.number), bool) if seen is None else seen
                        has = has[~seen[has]]
                        seen[has] = True
                    if len(has):
                        mails.append(mail), places.append(at), found.append(terms.rows_of(has))
                        size += len(found[-1])
                    if size > WINDOW:
                        yield out(b)
                        size = 0
                elif kind == _LIVE:
                    alive, since, key, held, seen = mail, generation, None, [], None
                elif kind == _TERM:
                    said.append(body), near.append(gram)
        if size:
            yield out(b)

    return make


class TextIndex:
    """An index in a folder: generations of postings, their counts by gram, and each mail's generation."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = BucketedTable(spark, f"{self.folder}/state", key="email_id", buckets=buckets)

    def _generation(self) -> int:
        return len(self.state.versions()) and int(self.state.versions()[-1].partition("-")[2]) + 1

    def update(self, chunks: DataFrame, actions: DataFrame) -> None:
        """Takes up the chunks of mails to embed, and drops what is to be deleted (V08's actions: email_id, action)."""
        n = self._generation()
        fresh = chunks.join(actions.where("action = 'embed'").select("email_id"), "email_id", "left_semi")
        chars = fresh.withColumn("low", F.lower("content")).withColumn("chars", F.filter(F.split("low", ""), lambda c: c != ""))
        at = lambda i: F.coalesce(F.get("chars", i), F.lit(""))
        every = F.array_distinct(F.transform("chars", lambda c, i: F.concat(c, at(i + 1), at(i + 2))))
        rows = cut(chars.select(F.explode(every).alias("gram"), "email_id", "chunk_index"), "grams")  # read twice: ranges are sampled first
        rows.repartitionByRange("gram", "email_id").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.folder}/postings/generation={n}")
        self.spark.read.parquet(f"{self.folder}/postings/generation={n}").groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/counts/generation={n}")

        def apply(old: DataFrame | None, batch: DataFrame) -> DataFrame:
            kept = batch.where("action = 'embed'").select("email_id", F.lit(n).alias("since"))
            return kept if old is None else old.join(batch.select("email_id"), "email_id", "left_anti").select("email_id", "since").unionByName(kept)

        self.state.write(apply, actions.where("action <> 'keep'").select("email_id", "action"), n, 0, "index")

    def compacted(self, folder: str, chunks: DataFrame) -> TextIndex:
        """A new index of the mails that count, in one generation."""
        out, live = TextIndex(self.spark, folder), self.state.rows()
        out.update(chunks, live.select("email_id", F.lit("embed").alias("action")))
        return out

    def _long(self, said: DataFrame) -> DataFrame:
        """Each gram of terms (low) that have one."""
        return said.where(F.char_length("low") >= GRAM).withColumn("gram", F.explode(F.filter(grams(F.col("low")), lambda g: F.char_length(g) == GRAM)))

    def _begun(self, said: DataFrame, totals: DataFrame) -> DataFrame:
        """begin, gram: the grams that begin with a term (low) which is shorter than they are."""
        begins = said.where(F.char_length("low") < GRAM).select(F.col("low").alias("begin")).distinct()
        first = F.explode(F.array(F.struct(F.substring("gram", 1, 1).alias("begin"), "gram"), F.struct(F.substring("gram", 1, 2).alias("begin"), "gram"))).alias("b")
        return totals.select(first).select("b.begin", "b.gram").distinct().join(begins, "begin")

    def _totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/counts").groupBy("gram").agg(F.sum("n").alias("n"))

    def _postings(self, wanted: DataFrame) -> tuple[DataFrame, bool]:
        """All postings, or those of the wanted grams if the scan itself can leave out what other grams lie in; and whether it can."""
        postings = self.spark.read.parquet(f"{self.folder}/postings")
        few = wanted.select("gram").distinct().limit(MOST_NAMED + 1).collect()
        named = len(few) <= MOST_NAMED
        return (postings.where(F.col("gram").isin([r["gram"] for r in few])) if named else postings), named

    def candidates(self, terms: DataFrame, most_grams: int = 3) -> DataFrame:
        """term_id, term, email_id, chunk_index of chunks that have the rarest grams of each term.  terms: term_id, term, none empty."""
        said = terms.select("term_id", "term", F.lower("term").alias("low")).where("low <> ''")
        short = said.where(F.char_length("low") < GRAM)
        totals = self._totals()
        rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, most_grams)
        chosen = self._long(said).join(totals, "gram", "left").groupBy("term_id", "term").agg(rarest.alias("g")).select("term_id", "term", F.size("g").alias("needs"), F.explode("g.gram").alias("gram"))
        begun = self._begun(said, totals)
        live = self.state.rows()
        if live is None:
            return terms.select("term_id", "term", F.lit("").alias("email_id"), F.lit(0).alias("chunk_index")).limit(0)
        postings, _ = self._postings(chosen.select("gram").unionByName(begun.select("gram")))
        counted = postings.join(live.withColumnRenamed("since", "generation"), ["email_id", "generation"], "left_semi").select("gram", "email_id", "chunk_index")
        found = counted.join(chosen, "gram").select("term_id", "term", "needs", "email_id", "chunk_index")
        if most_grams > 1:  # of one gram a chunk has one row
            found = found.groupBy("term_id", "term", "needs", "email_id", "chunk_index").agg(F.count("*").alias("has")).where("has >= needs")
        # a chunk has many grams that begin with a short term: what they begin with is made one row before terms meet it
        places = counted.join(begun, "gram").select("begin", "email_id", "chunk_index").distinct()
        brief = places.join(short, F.col("begin") == F.col("low"))
        return found.select("term_id", "term", "email_id", "chunk_index").unionByName(brief.select("term_id", "term", "email_id", "chunk_index"))

    def _held(self, chunks: DataFrame, terms: DataFrame, first: bool = False) -> DataFrame:
        """term_id, email_id, chunk_index of all chunks that hold a term, or of the first one of each mail."""
        kinds = {"email_id": chunks.schema["email_id"].dataType, "chunk_index": chunks.schema["chunk_index"].dataType, "generation": "int", "gram": "string", "body": "binary", "term_id": terms.schema["term_id"].dataType}
        shape = StructType([StructField(c, kinds[c]) for c in ("term_id", "email_id", "chunk_index")])
        live = self.state.rows()
        if live is None:
            return self.spark.createDataFrame([], shape)
        said, totals = terms.select("term_id", F.lower("term").alias("low")).where("low <> ''").distinct(), self._totals()
        rarest = self._long(said).join(totals, "gram", "left").groupBy("term_id", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
        short = said.where(F.char_length("low") < GRAM).select("term_id", "low", F.lit(None).cast("string").alias("gram"))
        chosen = cut(rarest.select("term_id", "low", "g.gram").unionByName(short), "chosen")
        postings, named = self._postings(chosen.select("gram").where("gram IS NOT NULL").unionByName(self._begun(chosen, totals).select("gram")))
        texts = chunks.where("email_id IS NOT NULL AND chunk_index IS NOT NULL AND content IS NOT NULL").select("email_id", "chunk_index", F.lower("content").cast("binary").alias("body"))
        if named:
            texts = texts.join(postings.select("email_id", "chunk_index").distinct(), ["email_id", "chunk_index"], "left_semi")
        wanted = chosen.select("gram").distinct().join(totals, "gram")
        size = wanted.agg(F.count("*").alias("grams"), F.sum("n").alias("rows")).first()
        if not named:  # short terms are compared with the texts and need no postings
            postings = postings.join(F.broadcast(wanted) if size["grams"] <= MOST_BROADCAST else wanted, "gram", "left_semi")
        parts = max(2 * self.spark.sparkContext.defaultParallelism, -(-(size["rows"] or 0) // MOST_POSTINGS))
        asked = chosen.count()
        shares = max(1, -(-asked // MOST_TERMS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = F.pmod(F.xxhash64("email_id"), F.lit(parts)).cast("int")
        share = lambda c: F.pmod(F.xxhash64(c), F.lit(shares)).cast("int")

        def sent(kind: int, df: DataFrame, **columns: Column) -> DataFrame:
            return df.select((F.col("part") * shares + F.col("share")).alias("cell"), F.lit(kind).alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

        col = lambda *names: {c: F.col(c) for c in names}
        rows = sent(_TERM, chosen.withColumn("share", share(F.coalesce("gram", "low"))).withColumn("part", every(parts)), body=F.col("low").cast("binary"), **col("gram", "term_id"))
        rows = rows.unionByName(sent(_LIVE, live.withColumn("part", part).withColumn("share", every(shares)), generation=F.col("since"), **col("email_id")))
        rows = rows.unionByName(sent(_POSTING, postings.where("chunk_index IS NOT NULL").withColumn("part", part).withColumn("share", share("gram")), **col("email_id", "chunk_index", "generation", "gram")))
        rows = rows.unionByName(sent(_TEXT, texts.withColumn("part", part).withColumn("share", every(shares)), **col("email_id", "chunk_index", "body")))
        met = rows.repartitionById(parts * shares, "cell").sortWithinPartitions("email_id", "chunk_index", "kind").drop("cell").mapInArrow(_meeting(first), shape)
        if first and asked > chosen.select("term_id").distinct().count():  # several terms of one id
            met = met.groupBy("term_id", "email_id").agg(F.min("chunk_index").alias("chunk_index"))
        return met

    def search(self, chunks: DataFrame, terms: DataFrame) -> DataFrame:
        """term_id, email_id, chunk_index, content of all chunks that hold a term, whatever its case."""
        return self._held(chunks, terms).join(chunks.select("email_id", "chunk_index", "content"), ["email_id", "chunk_index"]).select("term_id", "email_id", "chunk_index", "content")

    def first_places(self, chunks: DataFrame, terms: DataFrame) -> DataFrame:
        """term_id, email_id, chunk_index of the first chunk of each mail that holds a term; no text is carried along."""
        return self._held(chunks, terms, first=True)

    def first_mentions(self, chunks: DataFrame, terms: DataFrame) -> DataFrame:
        """The first chunk of each mail that holds a term (W01), for many terms at once."""
        return self.first_places(chunks, terms).join(chunks.select("email_id", "chunk_index", "content"), ["email_id", "chunk_index"]).select("term_id", "email_id", "chunk_index", "content")
