"""Operator 3: find test items inside training text.

Test items go into a BM25 inverted index whose postings stand in blocks, each with the
greatest score it can give. Every passage of every document is a query. Items are found
document at a time in the manner of block-max WAND: a pivot is the first item at which the
terms' bounds can pass the threshold, its blocks' bounds are tried next, and only then is
it scored; otherwise whole blocks are skipped. First a passage is tried against each
item's rarest words: an item's other words together stay below its threshold, so what these
lack the rare ones must bring. A passage is queried
for the items for which it brings that, and whose words in it are enough together.
No item above the threshold is lost by either bound.

An item's threshold is a share of its own highest score, that of its full text. A found
item is verified on the words: the share of its question's shingles, and of its answer's,
that the passage holds must both be large. The answer is the item's last sentence where it
has more than one, the question what stands before; an item of one sentence is a question.
An answer of fewer than ANSWER words has too few shingles to stand an edit; then a large
share of the shingles of the whole item will do as well.

Number and mean length of the items and the number of items with each word are counted by Spark over all items,
so no score depends on how items are dealt out. Indexes hold items of one
class of length and about BLOCK_BYTES of text; tasks build them and write them
to shared storage, and the tasks that scan documents read one at a time. More items make more indexes, and each
is put to all passages in its turn. Documents are only ever scanned.

Defined cases: null text or item gives nothing; an item with fewer words than a shingle is
matched as a whole sequence; a long item is looked for in passages twice as long as its class of length allows,
which leaves the passages for others as they are; repeated documents give their matches again, repeated items once; an
empty benchmark leaves all documents clean; columns other than doc_id, text, item_id are left out here.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm import vectors as v
from stopwise.llm.cluster import prepare, shared_path, stored

PASSAGE = 128  # words of a passage for items of half as many, doubled for each class of longer ones; the next one starts half as far on
SHARE = 0.5  # of an item's own score
OVERLAP = 0.6  # of the shingles of question and answer
ANSWER = 8  # words of an answer that is judged by itself only
SHINGLE = 4
K1, B = 1.2, 0.75
POSTINGS = 32  # in a block
BLOCK_BYTES = 8 << 20  # text of the items of an index
PAIRS = 1 << 21  # of passages and items' rare words at once
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, begin long, end long"

# Bytes that do not belong to a word once texts are lower-cased: all of ASCII but letters and digits.
APART = np.zeros(256, bool)
APART[[c for c in range(128) if not chr(c).isalnum()]] = True
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def cut(texts: list[str | None]) -> v.Words:
    return v.words(*v.utf8(pc.utf8_lower(pa.array(texts, pa.string()))), APART)


@dataclass
class Index:
    """Items by term. A term's postings lie in offsets[t] to offsets[t + 1], sorted by item."""

    terms: np.ndarray  # sorted hashes
    bound: np.ndarray  # of each term
    offsets: np.ndarray
    item: np.ndarray
    score: np.ndarray  # a term's part in the score of the item
    items_of: list[list[int]]  # by term: its items, their scores, and the bound and last item of each block
    scores_of: list[list[float]]
    bounds_of: list[list[float]]
    lasts_of: list[list[int]]
    threshold: np.ndarray  # by item
    least: float
    passage: int
    key_offsets: np.ndarray  # by term: the items of which it is one of the rarest words, and its part in their scores
    key_item: np.ndarray
    key_score: np.ndarray
    need: np.ndarray  # what an item needs from its rarest words to reach its threshold
    own_offsets: np.ndarray  # by item: its terms and their parts in its score
    own_term: np.ndarray
    own_score: np.ndarray
    ids: list
    questions: list[frozenset]
    answers: list[frozenset]
    wholes: list[frozenset | None]  # of items with a short answer


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> frozenset:
    if not len(hashes):
        return frozenset()
    size = min(size, len(hashes))
    return frozenset(v.Rolling(hashes).windows(size).tolist())


@dataclass
class Item:
    """An item with its words: different ones, how often it has each, and how many items have it."""

    key: int | None
    text: str
    size: int
    terms: np.ndarray
    counts: np.ndarray
    frequency: np.ndarray


def build(items: list[Item], n: int, mean: float, passage: int = PASSAGE) -> Index:
    """The index of some of n items, whose mean length is given."""
    split = [(m[-1].end() if (m := list(SENTENCE.finditer(t))) else None, t) for t in (x.text.strip() for x in items)]
    questions = cut([t if at is None else t[:at] for at, t in split])
    answers = cut(["" if at is None else t[at:] for at, t in split])
    wholes = cut([x.text for x in items])
    hashes = [words.hashes() for words in (questions, answers, wholes)]
    part = lambda k, words, i: shingle_set(hashes[k][words.first[i] : words.first[i + 1]])
    short = [0 < k < ANSWER for k in np.diff(answers.first).tolist()]
    own = np.repeat(np.arange(len(items)), [len(x.terms) for x in items])
    term, count, often = (np.concatenate([getattr(x, name) for x in items]) for name in ("terms", "counts", "frequency"))
    size = np.array([x.size for x in items], float)[own]
    score = np.log(1 + (n - often + 0.5) / (often + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))
    threshold = SHARE * np.bincount(own, score, minlength=len(items))
    # From an item's most frequent word on: those that together stay below the threshold are not its keys.
    order = np.lexsort((term, -often, own))
    reached = np.cumsum(score[order])
    start = np.concatenate([[0.0], reached])[np.searchsorted(own, np.arange(len(items)))]
    common = np.zeros(len(term), bool)
    common[order] = reached - start[own[order]] < threshold[own[order]] * (1 - 1e-9)
    need = threshold - np.bincount(own, np.where(common, score, 0.0), minlength=len(items))

    def by_term(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.flatnonzero(chosen)
        place = place[np.lexsort((own[place], term[place]))]
        return np.searchsorted(term[place], np.append(terms, np.uint64(0)))[:-1], own[place], score[place]

    terms = np.unique(term)
    begin, item_, score_ = by_term(np.ones(len(term), bool))
    offsets = np.append(begin, len(item_))
    key_begin, key_item, key_score = by_term(~common)
    cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    split_items, split_scores = ([column[a:z].tolist() for a, z in cuts] for column in (item_, score_))
    blocks = [range(0, len(x), POSTINGS) for x in split_items]
    bounds = [[max(x[b : b + POSTINGS]) for b in some] for x, some in zip(split_scores, blocks)]
    lasts = [[x[min(b + POSTINGS, len(x)) - 1] for b in some] for x, some in zip(split_items, blocks)]
    most = np.maximum.reduceat(score_, offsets[:-1])
    return Index(terms, most, offsets, item_, score_, split_items, split_scores, bounds, lasts, threshold, float(threshold.min(initial=math.inf)), passage, np.append(key_begin, len(key_item)), key_item, key_score, need, np.searchsorted(own, np.arange(len(items) + 1)), np.searchsorted(terms, term), score, [x.key for x in items],
                 [part(0, questions, i) for i in range(len(items))], [part(1, answers, i) for i in range(len(items))], [part(2, wholes, i) if few else None for i, few in enumerate(short)])


def search(index: Index, terms: list[int], least: float, able: list[int] | None = None) -> list[tuple[int, float]]:
    """Items whose score reaches their threshold and `least`; terms: distinct term numbers of a passage.

    With `able`, a sorted list, only these items are looked for and all others are skipped.
    """
    found = []
    bounds = [float(index.bound[t]) for t in terms]
    items, scores, block_bounds, block_lasts = ([column[t] for t in terms] for column in (index.items_of, index.scores_of, index.bounds_of, index.lasts_of))
    at = [0] * len(terms)
    live = sorted(range(len(terms)), key=lambda k: items[k][0])
    while live:
        total, pivot = 0.0, None
        for n, k in enumerate(live):
            total += bounds[k]
            if total >= least:
                pivot = n
                break
        if pivot is None:
            break
        target = items[live[pivot]][at[live[pivot]]]
        if able is not None:
            nearest = bisect_left(able, target)
            if nearest == len(able):
                break
            if able[nearest] > target:
                for k in live:
                    at[k] = bisect_left(items[k], able[nearest], at[k])
                live = sorted((k for k in live if at[k] < len(items[k])), key=lambda k: items[k][at[k]])
                continue
        while pivot + 1 < len(live) and items[live[pivot + 1]][at[live[pivot + 1]]] == target:
            pivot += 1
        ahead = live[: pivot + 1]
        # The blocks that would hold the pivot's item bound its score.
        block, reach = 0.0, math.inf
        for k in ahead:
            b = bisect_left(block_lasts[k], target, at[k] // POSTINGS)
            if b < len(block_lasts[k]):
                block += block_bounds[k][b]
                reach = min(reach, block_lasts[k][b])
        if block >= least:
            score, skip = 0.0, target + 1
            for k in ahead:
                p = bisect_left(items[k], target, at[k])
                if p < len(items[k]) and items[k][p] == target:
                    score += scores[k][p]
            if score >= index.threshold[target]:
                found.append((target, score))
        else:
            # No item up to the end of these blocks, or to the next term's item, can pass.
            beyond = items[live[pivot + 1]][at[live[pivot + 1]]] if pivot + 1 < len(live) else math.inf
            skip = max(min(reach + 1, beyond), target + 1)
        for k in ahead:
            at[k] = bisect_left(items[k], skip, at[k])
        live = sorted((k for k in live if at[k] < len(items[k])), key=lambda k: items[k][at[k]])
    return found


def overlap(wanted: frozenset, held: set) -> float:
    return len(wanted & held) / len(wanted) if wanted else 1.0


def promising(index: Index, words: v.Words, term: np.ndarray, known: np.ndarray, count: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """Passages with the items whose rarest words in it bring what the item needs, in order."""
    at = np.flatnonzero(known & (index.key_offsets[term + 1] > index.key_offsets[term]))
    # A word lies in the passage that starts in its half and in the one before; a passage counts it once.
    half = (at - words.first[words.doc[at]]) // step
    base = (np.cumsum(count) - count)[words.doc[at]]
    found = []
    for shift in (0, 1):
        inside = (half - shift >= 0) & (half - shift < count[words.doc[at]])
        found.append((base + half - shift)[inside] * len(index.terms) + term[at[inside]])
    passage, word = np.divmod(np.unique(np.concatenate(found)), len(index.terms))
    sizes = index.key_offsets[word + 1] - index.key_offsets[word]
    total = np.cumsum(sizes)
    start = 0
    while start < len(passage):  # whole passages, about PAIRS at a time
        end = np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")
        end = np.searchsorted(passage, passage[min(max(end, start + 1), len(passage)) - 1], "right")
        many = sizes[start:end]
        place = np.repeat(index.key_offsets[word[start:end]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        key, where = np.unique(np.repeat(passage[start:end], many) * len(index.ids) + index.key_item[place], return_inverse=True)
        gain = np.bincount(where, index.key_score[place], minlength=len(key))
        key = key[gain >= index.need[key % len(index.ids)] - 1e-9]
        hit, first = np.unique(key // len(index.ids), return_index=True)
        yield from zip(hit.tolist(), np.split(key % len(index.ids), first[1:]))
        start = int(end)


def reachable(index: Index, able: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Those of some items that the words at hand, flagged by term, can bring to their threshold."""
    begin, many = index.own_offsets[able], index.own_offsets[able + 1] - index.own_offsets[able]
    first = np.cumsum(many) - many
    place = np.repeat(begin - first, many) + np.arange(int(many.sum()))
    total = np.add.reduceat(np.where(present[index.own_term[place]], index.own_score[place], 0.0), first)
    return able[total >= index.threshold[able] - 1e-9]


def matches_of(part: pa.RecordBatch, index: Index) -> list[tuple]:
    """(row, item_id, score, question overlap, answer overlap, begin, end) of the passages of a batch."""
    words = v.words(*v.utf8(pc.utf8_lower(part.column("text"))), APART)
    if not len(words.start) or not len(index.terms):
        return []
    hashes = words.hashes()
    term = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[term] == hashes
    # Passages start at every half passage of a text; the last one ends with it.
    step = index.passage // 2
    size = np.diff(words.first)
    count = np.maximum(-(-(size - step) // step), 1) * (size > 0)
    doc = np.repeat(np.arange(part.num_rows), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = words.first[doc] + nth * step
    end = np.minimum(begin + index.passage, words.first[doc + 1])
    out = []
    present = np.zeros(len(index.terms), bool)
    for p, able in promising(index, words, term, known, count, step):
        a, z = int(begin[p]), int(end[p])
        terms = np.unique(term[a:z][known[a:z]])
        present[terms] = True
        able = reachable(index, able, present)
        present[terms] = False
        if not len(able):
            continue
        held = None
        for item, score in search(index, terms.tolist(), float(index.threshold[able].min()) - 1e-9, able.tolist()):
            if held is None:
                held = set()
                for size in {SHINGLE, *range(1, SHINGLE)}:
                    if z - a >= size:
                        held |= set(v.Rolling(hashes[a:z]).windows(size).tolist())
            question, answer = overlap(index.questions[item], held), overlap(index.answers[item], held)
            whole = index.wholes[item]
            if question >= OVERLAP and answer >= OVERLAP or whole is not None and overlap(whole, held) >= OVERLAP:
                base = int(words.first[doc[p]])
                out.append((int(doc[p]), index.ids[item], score, question, answer, a - base, z - base))
    return out


ITEMS = "item_id long, text string, size long, terms array<long>, counts array<long>"


def items_of(benchmark: DataFrame) -> DataFrame:
    """ITEMS: the different rows that have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = cut(batch.column("text").to_pylist())
            hashes = words.hashes()
            held = [np.unique(hashes[a:z], return_counts=True) for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            size = np.diff(words.first)
            columns = [batch.column("item_id"), batch.column("text"), pa.array(size, pa.int64()), pa.array([t.view(np.int64).tolist() for t, _ in held], pa.list_(pa.int64())), pa.array([c.tolist() for _, c in held], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, [c.split()[0] for c in ITEMS.split(", ")]).filter(pa.array(size > 0))

    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"]).filter("text IS NOT NULL").distinct()
    return rows.mapInArrow(count, ITEMS)


def indexes_of(benchmark: DataFrame) -> list[str]:
    """Files with the indexes of all items, built in tasks: paths in shared storage."""
    spark = benchmark.sparkSession
    items = stored(items_of(benchmark), "items").withColumns({"print": F.xxhash64("text"), "longer": F.greatest(F.ceil(F.log2(2 * F.col("size") / PASSAGE)), F.lit(0)).cast("int")})
    sums = items.groupBy("longer").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each doubling of length
    n = sum(row.n for row in sums)
    if not n:
        return []
    mean = sum(row.words for row in sums) / n
    parts = F.create_map(*[F.lit(x) for row in sums for x in (row.longer, -(-row.bytes // BLOCK_BYTES))])
    part = F.struct("longer", F.pmod(F.xxhash64("item_id", "text"), parts[F.col("longer")]).alias("part")).alias("block")
    often = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("often"))
    words = items.select("item_id", "print", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("item_id", "print", F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))
    counted = words.join(often, "term").groupBy(F.coalesce("item_id", F.lit(0)).alias("_id"), F.isnull("item_id").alias("_none"), "print").agg(F.collect_list(F.struct("term", "count", "often")).alias("words"))
    whole = items.select(F.coalesce("item_id", F.lit(0)).alias("_id"), F.isnull("item_id").alias("_none"), "print", "item_id", "text", "size", part).join(counted, ["_id", "_none", "print"])
    folder = shared_path(spark, "indexes")

    def save(items: list[Item], longer: int) -> str:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name = uuid.uuid4().hex  # a second attempt writes a file of its own; only those that the result names are read
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(pickle.dumps(build(items, n, mean, PASSAGE << longer)))
        return f"{folder}/{name}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []
        for batch in batches:
            for block, key, text, size, found in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text", "size", "words"))):
                if block != now and held:
                    done.append(save(held, now["longer"]))
                    held = []
                now = block
                terms = np.array([x["term"] for x in found], np.int64).view(np.uint64)
                held.append(Item(key, text, size, terms, *(np.array([x[c] for x in found], float) for c in ("count", "often"))))
        if held:
            done.append(save(held, now["longer"]))
        yield pa.record_batch([pa.array(done, pa.string())], ["path"])

    ordered = whole.select("block", "item_id", "text", "size", "words").repartition("block").sortWithinPartitions("block", "item_id", "text")
    return sorted(row.path for row in stored(ordered.mapInArrow(work, "path string"), "index_files").collect())


_read: dict[str, Index] = {}


def index_at(path: str) -> Index:
    """An index from its file; a worker keeps the last one."""
    if path not in _read:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as file:
            found = pickle.loads(file.read())
        _read.clear()
        _read[path] = found
    return _read[path]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """SCHEMA: every passage (words begin to end - 1) of every document with each item verified in it."""
    prepare(docs.sparkSession)

    def scan(path: str) -> DataFrame:
        def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_at(path)
            for batch in batches:
                for part in v.pieces(batch):
                    ids = part.column("doc_id").to_pylist()
                    columns = list(zip(*((ids[row], *rest) for row, *rest in matches_of(part, index)))) or [[]] * 7
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(query, SCHEMA)

    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for path in indexes_of(benchmark):
        found = found.unionByName(scan(path))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no item was verified."""
    prepare(docs.sparkSession)
    for path in indexes_of(benchmark):

        def keep(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            index = index_at(path)
            for batch in batches:
                for part in v.pieces(batch):
                    stays = np.ones(part.num_rows, bool)
                    stays[[row for row, *_ in matches_of(part, index)]] = False
                    yield part.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best passage of each document for each item verified in it."""
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "begin", "end"), F.struct(F.round("score", 9), -F.col("begin"))).alias("_best")
    rows = contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_passages"), best)
    return rows.select("doc_id", "item_id", "n_passages", "_best.*")
