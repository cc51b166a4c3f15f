"""Removal of word passages that also stand in an earlier document, by suffix automata of reference shards.

1. Every window of ``length`` words has an anchor: the least hash among its 8-word grams, which depends on the
   window alone. Anchors that stand in two documents or more go into a filter of fixed size.
2. Windows whose anchor passes the filter are candidates, by a 64-bit fingerprint. A fingerprint's owner is the
   smallest doc_id that has it; owners' windows, merged to spans, are the reference: each repeated
   passage once.
3. Reference spans are dealt to shards of bounded size by their owner. A shard's suffix automaton over words is
   broadcast to the tasks that need it: built there from its spans. Documents stream through the automata of
   the owners of their candidate windows; matching statistics give, at each word, the state of the last
   `length` words, and with it the smallest doc_id in whose span they occur. Words themselves are compared,
   so a fingerprint that two windows share by accident removes nothing.
4. Words under windows of a smaller doc_id go: maximal spans of at least `length` words.

A passage in a third of all documents is one reference span; its documents are dealt to several tasks, each with the
same automaton. Null and empty texts have no words; rows with a null doc_id neither lose words nor count
as earlier; rows that share a doc_id don't remove each other's words; repeated rows get equal results; an
empty table gives none; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_size, cut, flat, grouped, in_bloom, release, shuffle_partitions, slices
from .words import hash_words, mix, sliding_min, split_words, window_hashes

LENGTH, GRAM = 50, 8
SHARD_WORDS, TASK_WORDS = 30_000, 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def _windows(data: np.ndarray, offsets: np.ndarray, length: int):
    """Starts and ends of words, rows of words, first word of each row; for window starts, whether it lies in one row; anchors; word hashes."""
    starts, ends, rows = split_words(data, offsets)
    h = hash_words(data, starts, ends)
    anchors = sliding_min(window_hashes(h, GRAM), length - GRAM + 1)
    n = len(anchors)
    whole = rows[:n] == rows[length - 1 : length - 1 + n] if n else np.zeros(0, bool)
    return starts, ends, rows, whole, anchors, h


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                _, _, rows, whole, anchors, _ = _windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                at = np.flatnonzero(whole)
                a, r = anchors[at], rows[at]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(mix(a[new]).view(np.int64)), pa.array(ids[i + r[new]])], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def _candidates(docs: DataFrame, words: np.ndarray, length: int, texts: bool) -> DataFrame:
    """Windows with a shared anchor: (fp, doc_id, at), at being copy * 2**32 + first word; or, with texts, per document its runs of such windows as (first word, text)."""
    kept = docs.sparkSession.sparkContext.broadcast(words)  # at most 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, rows, whole, anchors, h = _windows(part, offsets[i : j + 1] - offsets[i], length)
                at = np.flatnonzero(whole)
                at = at[in_bloom(kept.value, mix(anchors[at]))]
                if not len(at):
                    continue
                first = np.searchsorted(rows, np.arange(j - i))
                r = rows[at]
                if not texts:
                    fp = window_hashes(h, length)[at]
                    place = (copies[i + r] << 32) + (at - first[r])
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ids[i + r]), pa.array(place)], ["fp", "doc_id", "at"])
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] > at[:-1] + length) | (r[1:] != r[:-1])
                a = np.flatnonzero(new)
                b = np.concatenate((a[1:], [len(at)])) - 1
                run_rows = r[a]
                raw = part.tobytes()
                spans = [{"s": int(at[x] - first[q]), "text": " ".join(words_of(raw[starts[at[x]] : ends[at[y] + length - 1]].decode()))} for x, y, q in zip(a.tolist(), b.tolist(), run_rows.tolist())]
                edges = np.flatnonzero(np.concatenate(([True], run_rows[1:] != run_rows[:-1])))
                lists = [spans[x:y] for x, y in zip(edges, np.concatenate((edges[1:], [len(spans)])))]
                who = i + run_rows[edges]
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(copies[who]), pa.array(lists, pa.list_(pa.struct([("s", pa.int64()), ("text", pa.string())])))], ["doc_id", "copy", "runs"])

    schema = "doc_id long, copy long, runs array<struct<s: long, text: string>>" if texts else "fp long, doc_id long, at long"
    return docs.select("doc_id", "text", "copy").mapInArrow(run, schema)


def _runs_by_document(found: DataFrame, length: int, parts: int) -> DataFrame:
    """Windows (doc_id, at, lo) as runs (doc_id, copy, lo, s, e) of first words s..e with one owner lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at, lo = (batch.column(c).to_numpy() for c in ("doc_id", "at", "lo"))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]) | (at[1:] > at[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.concatenate((a[1:], [len(doc)])) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], at[a] >> 32, lo[a], at[a] & 0xFFFFFFFF, at[b] & 0xFFFFFFFF)], ["doc_id", "copy", "lo", "s", "e"])

    return found.select("doc_id", "at", "lo").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "at", "lo").mapInArrow(run, "doc_id long, copy long, lo long, s long, e long")


class Automaton:
    """Suffix automaton of several word lists; each state knows the smallest owner of the lists that its strings occur in."""

    def __init__(self, spans: list[tuple[int, list[str]]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.owner: list[float] = [float("inf")]
        for owner, words in spans:
            last = 0
            for w in words:
                last = self._extend(last, w)
                if owner < self.owner[last]:
                    self.owner[last] = owner
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.owner[v] < self.owner[p]:
                self.owner[p] = self.owner[v]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(float("inf"))
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: str) -> int:
        """The state for p's longest string with w, cut off from q where q's is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: str) -> int:
        if w in self.next[p]:
            return self._split(p, self.next[p][w], w)
        made = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][w], w)
        return made

    def ends(self, words: list[str], length: int, below: int) -> Iterator[int]:
        """Places at which the last `length` words are in a span of an owner below: matching statistics, cut to that length."""
        nxt, link, size, owner = self.next, self.link, self.length, self.owner
        v = n = 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = size[v]
            to = nxt[v].get(w)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= length:
                n = length
                while size[link[v]] >= length:
                    v = link[v]
                if owner[v] < below:
                    yield i


def _deal(runs: DataFrame, texts: DataFrame, length: int, shards: int) -> DataFrame:
    """Rows (shard, query, doc_id, copy, s, text, words): reference spans of owners, and for other documents the spans to stream through each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, copy, listed, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "runs", "windows"))):
                words = [(r["s"], r["text"].split(" ")) for r in listed]
                wanted: dict[tuple, list] = {}
                for x in own:
                    wanted.setdefault((x["lo"] != doc, int(mix(np.array([x["lo"]], np.int64).view(np.uint64))[0] % np.uint64(shards))), []).append((x["s"], x["e"]))
                for (query, shard), spans in wanted.items():
                    spans.sort()
                    merged = [list(spans[0])]
                    for s, e in spans[1:]:
                        if s <= merged[-1][1] + 1:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        for first, w in words:
                            a, b = s - first, e + length - first
                            if 0 <= a and b <= len(w):
                                rows.append((shard, query, doc, copy, s, " ".join(w[a:b]), b - a))
                                break
            if rows:
                kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 5000]), kinds)], ["shard", "query", "doc_id", "copy", "s", "text", "words"])

    per = runs.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "s", "e")).alias("windows"))
    joined = per.join(texts, ["doc_id", "copy"]).select("doc_id", "copy", "runs", "windows")
    return joined.mapInArrow(run, "shard int, query boolean, doc_id long, copy long, s long, text string, words long")


def _stream(dealt: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc_id, copy, a, b): removed words a..b - 1, from streaming the query spans through their shards' automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["shard", "salt"]):
            rows, spans, automaton = [], [], None
            for query, doc, copy, s, text in zip(*(group.column(c).to_pylist() for c in ("query", "doc_id", "copy", "s", "text"))):
                words = text.split(" ")
                if not query:
                    spans.append((doc, words))
                    continue
                if automaton is None:
                    automaton = Automaton(spans)
                a = b = -1
                for end in automaton.ends(words, length, doc):
                    if end - length + 1 > b:
                        if b > a:
                            rows.append((doc, copy, s + a, s + b))
                        a = end - length + 1
                    b = end + 1
                if b > a:
                    rows.append((doc, copy, s + a, s + b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "copy", "a", "b"])

    loads = cut(dealt.where("query").groupBy("shard").agg(F.sum("words").alias("load")).select("shard", F.greatest(F.lit(1), F.ceil(F.col("load") / TASK_WORDS)).cast("int").alias("salts")), "loads")
    salted = dealt.join(loads, "shard")
    salt = F.when(F.col("query"), F.array(F.pmod(F.xxhash64("doc_id", "copy"), F.col("salts")).cast("int"))).otherwise(F.expr("sequence(0, salts - 1)"))
    spread = salted.withColumn("salt", F.explode(salt)).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "query", "doc_id")
    return spread.select("shard", "salt", "query", "doc_id", "copy", "s", "text").mapInArrow(run, "doc_id long, copy long, a long, b long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, copy, spans): merged spans of words (a, b) to remove, for documents that have any. docs: doc_id, text, copy."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.where("doc_id is not null and text is not null")
    shared = anchors_of(docs, length).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = cut(shared, "anchors")
    words = bloom(shared, "anchor", bloom_size(shared.count()))
    windows = cut(_candidates(docs, words, length, False), "windows")
    owners = cut(windows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("fp", "lo"), "owners")
    release(spark)
    found = windows.join(owners, "fp")
    runs = cut(_runs_by_document(found, length, parts), "runs")
    release(spark)
    reference = runs.where("lo = doc_id").agg(F.sum(F.col("e") - F.col("s") + length).alias("w")).first()["w"] or 0
    texts = _candidates(docs, words, length, True)
    dealt = cut(_deal(runs, texts, length, max(1, -(-reference // SHARD_WORDS))), "dealt")
    spans = _stream(dealt, length, parts)
    return cut(spans.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")


def strip_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("copy"))
    spans = repeated_spans(rows, length)
    key = F.xxhash64("doc_id", "copy")
    named = spans.withColumn("h", key)
    words = spark.sparkContext.broadcast(bloom(named, "h", bloom_size(named.count())))
    schema = "doc_id long, n_words long, n_removed long, kept_text string"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                out = []
                lists = part.column("spans").to_pylist() if "spans" in part.schema.names else [None] * part.num_rows
                for text, gone in zip(part.column("text").to_pylist(), lists):
                    w = words_of(text)
                    n = len(w)
                    if gone:
                        stay, at = [], 0
                        for x in gone:
                            stay += w[at : x["a"]] if x["a"] > at else []
                            at = max(at, x["b"])
                        w = stay + w[at:]
                    out.append((n, n - len(w), " ".join(w)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_text"])

    def maybe(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                on = in_bloom(words.value, batch.column("h").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(on == want)).select(["doc_id", "text", "copy"])

        return run

    keyed = rows.withColumn("h", key)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kept(maybe(False)(batches))

    others = keyed.mapInArrow(clean, schema)
    held = keyed.mapInArrow(maybe(True), "doc_id long, text string, copy long").join(spans, ["doc_id", "copy"], "left")
    return others.unionByName(held.select("doc_id", "text", "spans").mapInArrow(kept, schema))
