"""Personal data by bootstrapped contextual extraction.

Base patterns (e-mail, ip, card, phone) find seed entities.  The two words before a seed form a lexical pattern; patterns and the
identifier-like strings that they introduce (five characters or more, with a digit, an at sign or an underscore) make a bipartite
graph, which Spark scores for ``rounds`` rounds.  A pattern's score is the mean trust in its distinct instances, shrunk by ``prior``
unknown ones.  Seeds have trust 1.  Any other instance has trust only through *other* patterns: the mean score of those confident ones
that introduce it too, or 0.  A pattern is confident if its score is ``confidence`` or more and it has ``support`` trusted instances
at least; so confidence travels from patterns with seeds, over the identifiers they share, to patterns without.  Confident patterns
mark all that they introduce, as spans of kind ``context``; base spans always stay.

Words and identifiers have any length, and any number of blanks may stand between.  Texts are read in narrow passes and never
shuffled: spans, and patterns as 64-bit hashes, are written to the shared folder and joined there.

Null texts are empty.  Repeated rows and null doc_ids give a row each.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, written

KINDS = ("email", "ip", "card", "phone", "context")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer
_local = re.compile(r"[A-Za-z0-9._%+-]").match
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_candidate = re.compile(r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+").finditer  # a word with one of these signs, each word looked at once
_not_digit = re.compile(r"[^0-9]").sub
_OPENING = "\"'([{<`"
#: The most confident patterns that are broadcast (as 64-bit hashes, so 8 MB); with more, spans are joined instead.
MOST_SENT = 1 << 20
_TRIM = "\"'()[]{}<>,;:.!?=*#$%&|`"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_USE = pa.struct([("pattern", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted: leftmost and non-overlapping for each kind."""
    out, last = [], 0
    for m in _domain(text):
        at = m.start()
        while at > last and _local(text, at - 1):
            at -= 1
        if at < m.start():
            last = m.end()
            out.append((at, 0, last))
    for m in _ip(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for kind, found, least, most in ((2, _card, 12, 19), (3, _phone, 9, 15)):
        for m in found(text):
            d = _not_digit("", m[0])
            if least <= len(d) <= most and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _words_before(text: str, at: int) -> str | None:
    """The two words before a place, lower-cased; None where there aren't two, or where the place is inside a word."""
    end = at
    while end and text[end - 1] in _OPENING:
        end -= 1
    if end == at and at and not text[at - 1].isspace():
        return None
    words = text[max(0, end - 80) : end].split()
    if end > 80 and len(words) < 3:  # the second word may begin before
        words, at = [], end
        while at and len(words) < 2:
            while at and text[at - 1].isspace():
                at -= 1
            end = at
            while at and not text[at - 1].isspace():
                at -= 1
            words[:0] = [text[at:end]] * (end > at)
    return " ".join(words[-2:]).lower() if len(words) > 1 else None


def uses(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Each seed, and each identifier-like string that touches no seed, with the pattern before it."""
    found = [(s, e, True) for s, _, e in spans]
    starts, last = [s for s, _, _ in spans], list(itertools.accumulate((e for _, _, e in spans), max))  # spans are sorted by start
    for m in _candidate(text):
        s, e = m.span()
        while s < e and text[s] in _TRIM:
            s += 1
        while s < e and text[e - 1] in _TRIM:
            e -= 1
        before = bisect_left(starts, e)
        if e - s >= 5 and not (before and last[before - 1] > s):
            found.append((s, e, False))
    out = []
    for s, e, seed in found:
        if (pattern := _words_before(text, s)) is not None:
            out.append({"pattern": _hash(pattern), "instance": _hash(text[s:e].lower()), "seed": seed, "start": s, "end": e})
    return out


def text_key(text: Column) -> list[Column]:
    """What stands for a text in joins: its hash and its size."""
    return [F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_bytes")]


def extract(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, base spans, and the uses of patterns."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, used = [], []
        for text in batch.column("text").fill_null("").to_pylist():
            spans.append(mine := base_spans(text))
            used.append(uses(text, mine))
        rows = [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans]
        return pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), batch.column("text_bytes"), pa.array(rows, pa.list_(_SPAN)), pa.array(used, pa.list_(_USE))], names=["doc_id", "text_hash", "text_bytes", "base", "uses"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), *text_key(F.col("text").cast("string")), F.col("text").cast("string"))
    return rows.mapInArrow(in_slices(make), "doc_id long, text_hash long, text_bytes int, base array<struct<start: int, kind: int, end: int>>, uses array<struct<pattern: long, instance: long, seed: boolean, start: int, end: int>>")


def confident_patterns(edges: DataFrame, rounds: int, confidence: float, support: int, prior: float) -> DataFrame:
    """edges: pattern, instance, seed (one row for each pair).  Returns the patterns to trust, with their scores.

    Everything is summed by pattern or by instance, with sums before each shuffle, so neither may be too common."""
    own = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
    scored = own.select("pattern", "n", "seeds", F.lit(0.0).alias("gained"), F.lit(0).cast("long").alias("accepted"))
    confident = None
    for i in range(rounds):
        scored = scored.select("pattern", "n", "seeds", ((F.col("seeds") + F.col("gained")) / (F.col("n") + prior)).alias("score"), (F.col("seeds") + F.col("accepted")).alias("trusted"))
        confident = written(scored.where((F.col("score") >= confidence) & (F.col("trusted") >= support)).select("pattern", "score"), "patterns")
        if i + 1 == rounds:
            break
        theirs = edges.where(~F.col("seed")).join(confident, "pattern").groupBy("instance").agg(F.count("*").alias("many"), F.sum("score").alias("total"))
        reach = edges.where(~F.col("seed")).join(theirs, "instance").join(confident, "pattern", "left")
        mine = F.coalesce("score", F.lit(0.0))
        others = F.col("many") - F.col("score").isNotNull().cast("long")
        gain = reach.where(others > 0).groupBy("pattern").agg(F.sum((F.col("total") - mine) / others).alias("gained"), F.count("*").alias("accepted"))
        scored = own.join(gain, "pattern", "left").select("pattern", "n", "seeds", F.coalesce("gained", F.lit(0.0)).alias("gained"), F.coalesce("accepted", F.lit(0).cast("long")).alias("accepted"))
    return confident


def _trusted(docs: DataFrame, rounds: int, confidence: float, support: int, prior: float) -> tuple[DataFrame, DataFrame]:
    """What ``extract`` finds, written with a number for each row, and the confident patterns."""
    found = written(extract(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    edges = found.select(F.explode("uses").alias("u")).groupBy("u.pattern", "u.instance").agg(F.max("u.seed").alias("seed"))
    return found, confident_patterns(written(edges, "edges"), rounds, confidence, support, prior)


def _marked(found: DataFrame, trusted: DataFrame) -> DataFrame:
    new = found.select("row", F.explode("uses").alias("u")).select("row", "u.*").where(~F.col("seed")).join(trusted, "pattern", "left_semi")
    more = new.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))  # of one text
    both = found.select("row", "doc_id", "text_hash", "text_bytes", "base").join(more, "row", "left")
    return both.select("row", "doc_id", "text_hash", "text_bytes", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start: int, kind: int, end: int>>")))).alias("spans"))


def find_spans(docs: DataFrame, rounds: int = 4, confidence: float = 0.5, support: int = 5, prior: float = 2.0) -> DataFrame:
    """For each row: its number, doc_id, base spans and all spans, as sorted arrays of (start, kind, end)."""
    return _marked(*_trusted(docs, rounds, confidence, support, prior))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and the spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    n = [of(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    more = F.size("spans") - F.size("base")
    return spans.select("doc_id", *n, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), more.cast("long").alias("n_context"))


def redacted(docs: DataFrame, rounds: int = 4, confidence: float = 0.5, support: int = 5, prior: float = 2.0, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of docs with all spans replaced in text, and n_chars counted anew; all other columns stay, null texts too.

    Up to ``most_sent`` confident patterns are broadcast, and each text's spans are found again in place: no text is shuffled.
    With more of them, further spans are joined by the text's hash and size."""
    found, trusted = _trusted(docs, rounds, confidence, support, prior)
    kept, few = docs.columns, trusted.count() <= most_sent
    if few:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r["pattern"] for r in trusted.select("pattern").toLocalIterator()))
        wide = docs
    else:
        more = _marked(found, trusted).where(F.size("spans") > F.size("base")).groupBy("text_hash", "text_bytes").agg(F.first(F.filter("spans", lambda s: s["kind"] == 4)).alias("pii_more"))
        keyed = docs.withColumns(dict(zip(("pii_hash", "pii_bytes"), text_key(F.col("text")), strict=True)))
        same = (F.col("pii_hash") == F.col("text_hash")) & (F.col("pii_bytes") == F.col("text_bytes"))
        wide = keyed.join(more, same, "left").select(*[F.col(f"`{c}`") for c in kept], "pii_more")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        base = [base_spans(t) if t else [] for t in texts]
        if few:
            more = [[(u["start"], 4, u["end"]) for u in uses(t, b) if not u["seed"] and u["pattern"] in known.value] if t and known.value else [] for t, b in zip(texts, base, strict=True)]
        else:
            more = [[(s["start"], s["kind"], s["end"]) for s in m or []] for m in batch.column("pii_more").to_pylist()]
        out = [t if t is None else redact(t, [*b, *m]) for t, b, m in zip(texts, base, more, strict=True)]
        own = {"text": pa.array(out, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in out], pa.int64())}
        return pa.record_batch([own.get(c, batch.column(c)) for c in kept], names=kept)

    return wide.mapInArrow(in_slices(make), docs.schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind's name in brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
